"""Seasonal climate-impact analytics as Spark DataFrame transformations."""
