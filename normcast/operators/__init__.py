"""normcast.operators"""
