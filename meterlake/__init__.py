"""Hourly meter analytics and forecasting as lazy Spark DataFrame transformations."""
