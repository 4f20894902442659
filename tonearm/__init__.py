"""tonearm: a PySpark-native analytics engine for play histories."""

__version__ = "0.1.0"
