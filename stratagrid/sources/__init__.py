"""Readers and writers: point files, rasters, virtual rasters, file tables."""
