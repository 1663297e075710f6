"""Path-oriented analytics on Spark: short column-expression queries over semi-structured and tabular data."""
