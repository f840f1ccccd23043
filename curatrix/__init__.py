"""Curatrix: a PySpark-native engine for keeping a catalog of discovered artifacts truthful."""
