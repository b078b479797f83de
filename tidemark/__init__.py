"""tidemark: Spark-native analytics for irregular monitoring time series."""
