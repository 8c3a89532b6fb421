"""kbspark: a PySpark-native analytics engine for knowledge bundles."""

__version__ = "0.1.0"
