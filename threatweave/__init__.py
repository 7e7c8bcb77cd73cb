"""Threat-intelligence analytics as PySpark DataFrame operators."""
