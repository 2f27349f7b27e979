"""Session-variance analytics on Spark: DataFrame in, DataFrame out."""
