"""quirespark.plans"""
