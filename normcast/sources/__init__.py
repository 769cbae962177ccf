"""normcast.sources"""
