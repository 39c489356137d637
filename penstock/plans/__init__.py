"""penstock.plans"""
