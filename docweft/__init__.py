"""docweft: a Spark-native engine for document collections."""
