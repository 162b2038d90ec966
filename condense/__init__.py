"""Spark-native condensation of camera and sensor recordings."""

__version__ = "0.1.0"
