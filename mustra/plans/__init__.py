"""From requests to DataFrames."""
