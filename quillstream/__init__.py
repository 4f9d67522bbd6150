"""PySpark-native document intelligence, retrieval and training-data engine."""
