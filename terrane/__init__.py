"""terrane: a Spark-native semantic index and retrieval engine."""

__version__ = "0.1.0"
