"""The jobs. Each takes DataFrames and returns a lazy DataFrame."""
