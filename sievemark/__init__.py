"""A Spark-native engine for similarity, provenance and training-data analytics."""
