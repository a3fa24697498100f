"""PySpark-native analytics over crawled market data."""
