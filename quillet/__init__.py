"""quillet: a PySpark-native retrieval-analytics engine."""
