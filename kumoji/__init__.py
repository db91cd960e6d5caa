"""Spark-native transcript corpus engine: sources, operators, functions, plans and streaming."""

__version__ = "0.1.0"
