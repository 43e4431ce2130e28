"""lexmill: a PySpark-native lexical and corpus-analytics engine."""

__version__ = "0.1.0"
