"""normcast.streaming"""
