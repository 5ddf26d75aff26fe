"""SQL text to plans, and plans to DataFrames."""
