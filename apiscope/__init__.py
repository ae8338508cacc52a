"""API-surface analytics on Spark: DataFrame in, DataFrame out."""
