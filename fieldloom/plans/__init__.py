"""fieldloom.plans"""
