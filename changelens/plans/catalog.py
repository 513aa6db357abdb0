"""All registered queries over the given tables."""

from __future__ import annotations

from . import evidence_queries, operations_queries, page_queries, queries, store_queries, stream_queries, text_queries, workload_queries  # noqa: F401  they register
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
