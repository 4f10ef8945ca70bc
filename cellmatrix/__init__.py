"""A Spark-native engine for large sparse cell-by-gene matrices."""

__version__ = "0.2.0"
