"""A Spark-native engine for searchable documentation corpora."""
