"""What a request means, as columns and DataFrames."""
