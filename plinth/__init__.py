"""plinth: a PySpark-native engine for building and auditing language-model datasets."""

__version__ = "0.1.0"
