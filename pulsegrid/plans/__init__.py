"""Quality indicators: each function takes DataFrames and returns DataFrames."""
