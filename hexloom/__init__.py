"""Spatial aggregation on Spark: points and polygons to map-ready statistics."""
