"""Every operator applied to the test tables, with the SQL that gives the same rows."""

from shelfmark.bindings import columns, files, jobs, ranks, relations, stats, texts, vectors  # noqa: F401
from shelfmark.bindings.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
