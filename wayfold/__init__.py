"""Spark-native place resolution, spatial lookup and table analytics."""

__version__ = "0.1.0"
