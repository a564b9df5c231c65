"""Spark-native address resolution: text to country, town, postal code and street, with provenance."""

__version__ = "0.1.0"
