"""cairn: a PySpark-native query, change-log and event engine."""

__version__ = "0.1.0"
