"""Aerolith: a PySpark-native analytics engine for position telemetry."""

__version__ = "0.1.0"
