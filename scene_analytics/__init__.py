"""Spark-native analytics over embedding tables, pixel time series and masks."""
