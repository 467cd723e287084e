"""Strandloom: Spark-native sequencing-read analytics."""

__version__ = "0.1.0"
