"""Spark-first streaming-SQL analytics: bounded and streaming operators over one data model."""
