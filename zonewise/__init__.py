"""Spatial suitability ranking expressed as Spark DataFrame transformations."""
