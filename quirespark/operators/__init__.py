"""quirespark.operators"""
