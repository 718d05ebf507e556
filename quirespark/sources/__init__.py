"""quirespark.sources"""
