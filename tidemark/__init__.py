"""tidemark: a Spark-native engine for network telemetry analytics."""
