"""helixframe: a PySpark-native engine for splice-site analytics."""

__version__ = "0.1.0"
