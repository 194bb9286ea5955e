"""A Spark-native engine for versioned records and what is derived from them."""

__version__ = "0.1.0"
