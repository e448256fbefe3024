"""gridloom: a PySpark-native engine for network reliability and drifting network records."""

__version__ = "0.1.0"
