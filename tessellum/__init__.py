"""Tessellum: a PySpark-native analytics engine for knowledge corpora."""
