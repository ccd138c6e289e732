"""Spark-first analytics for laser-scan points and the rasters derived from them."""
