"""Tidewright: a Spark-first analytics engine for incident messages and demands."""

__version__ = "0.1.0"
