"""Tessera: Spark-native operators for time-series, point-cloud and trajectory data."""

__version__ = "0.1.0"
