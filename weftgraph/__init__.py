"""Spark-first analytics over knowledge graphs of source code."""
