"""Text formats of graphs and matrices, and lossless Parquet."""
