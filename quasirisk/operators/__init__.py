"""Risk metrics, outlier tests and mitigation steps: DataFrame in, DataFrame out."""
