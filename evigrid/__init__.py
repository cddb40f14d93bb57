"""Spatial analytics over uncertain, labelled observations, as Spark DataFrame operations."""
