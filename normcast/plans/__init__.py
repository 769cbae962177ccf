"""normcast.plans"""
