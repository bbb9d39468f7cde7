"""A Spark-native engine for large sparse count tables."""
