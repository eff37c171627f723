"""Readers and writers of files that Spark has none for."""
