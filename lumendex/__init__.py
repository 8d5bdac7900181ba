"""Spark-native media-catalogue and duplicate-resolution engine."""

__version__ = "0.1.0"
