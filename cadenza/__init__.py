"""Cadenza: a PySpark-native analytics engine for time series, catalogues and documents."""
