"""cairn: a PySpark-native analytics engine for personal knowledge archives."""

__version__ = "0.1.0"
