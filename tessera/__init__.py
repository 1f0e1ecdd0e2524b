"""Tile time-series analytics on Spark: composites, indices, anomaly labels, attribution, scoring."""
