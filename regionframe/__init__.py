"""Spark-first analytics for frame sequences and region labels."""
