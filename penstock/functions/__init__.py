"""penstock.functions"""
