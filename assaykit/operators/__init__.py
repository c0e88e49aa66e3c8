"""Analysis operators: each takes DataFrames and returns a flat, lazy DataFrame."""
