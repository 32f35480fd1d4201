"""Spatial statistics and corpus preparation as Spark DataFrame operators."""
