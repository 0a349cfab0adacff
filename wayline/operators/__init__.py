"""Building blocks: each takes DataFrames and returns a DataFrame."""
