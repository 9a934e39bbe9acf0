"""Tidewater: a PySpark-native analytics engine for resource-ownership analysis over program facts."""

__version__ = "0.1.0"
