"""A PySpark-native engine for spatial-temporal demand and fleet planning."""
