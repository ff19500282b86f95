"""Helpers that turn rule text into Spark SQL expressions."""
