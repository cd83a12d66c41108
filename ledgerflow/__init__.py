"""PySpark-native analytics over daily market and company data."""
