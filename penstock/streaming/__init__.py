"""penstock.streaming"""
