"""A PySpark-native engine for spatial ranking and log analytics."""
