"""Operators over job telemetry: each a plain function from DataFrames to a DataFrame."""
