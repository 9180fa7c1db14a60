"""spanwise: a PySpark-native engine for dense, position-indexed measurements over an ordered reference."""
