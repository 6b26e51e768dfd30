"""Degradation analytics as Spark DataFrame operators."""
