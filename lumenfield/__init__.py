"""Calibrated-image analytics on Spark: pixels, brackets and captures as DataFrames."""
