"""Spark-first engine for network-capture analytics."""
