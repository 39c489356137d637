"""penstock.operators"""
