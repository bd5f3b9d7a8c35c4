"""lodestone: a PySpark-native retrieval and content-analytics engine."""
