"""hayloft: a PySpark-native retrieval and corpus-processing engine."""
