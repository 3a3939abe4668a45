"""All registered queries with their SQL."""

from __future__ import annotations

from tidemark.plans import more, queries

QUERIES, ORACLES, flagship = queries.QUERIES, queries.ORACLES, queries.flagship
__all__ = ["ORACLES", "QUERIES", "flagship", "more"]
