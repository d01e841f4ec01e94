"""Waveform-feature analytics on Spark DataFrames."""
