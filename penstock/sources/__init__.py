"""penstock.sources"""
