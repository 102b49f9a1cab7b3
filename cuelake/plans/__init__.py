"""Registered queries over the given tables, and their SQL."""

from . import caption_queries, scalar_queries, segment_queries, source_queries, stream_queries, transcript_queries  # noqa: F401  register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
