"""Batch jobs that keep a text corpus searchable, as Spark DataFrame operations."""
