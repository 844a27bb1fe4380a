"""PySpark-native analytics for structure-based screening data."""
