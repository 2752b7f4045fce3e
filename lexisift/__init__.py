"""A PySpark-native engine for review anomaly analytics."""
