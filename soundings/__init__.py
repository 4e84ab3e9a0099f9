"""soundings: a PySpark-native engine for side-scan sonar survey data."""

__version__ = "0.1.0"
