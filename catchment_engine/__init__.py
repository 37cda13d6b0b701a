"""A PySpark-native engine for spatial-accessibility analytics."""
