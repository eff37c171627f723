"""Queries on the standard tables, by name, and SQL that gives the same rows."""

from rowtide.plans import caches, extensions, files, kernels, sequences, streams
from rowtide.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "caches", "extensions", "files", "kernels", "sequences", "streams"]
