"""Byte-stream and raster analytics on Spark DataFrames."""
