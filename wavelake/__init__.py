"""Wavelet-compressed raster images as relational data on Spark."""
