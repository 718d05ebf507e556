"""quirespark.functions"""
