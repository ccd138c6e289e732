"""Structured Streaming extension: rasters kept up to date while tiles arrive."""
