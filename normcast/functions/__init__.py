"""normcast.functions"""
