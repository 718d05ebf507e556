"""quirespark.streaming"""
