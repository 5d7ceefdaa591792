"""Queries over the given tables, each with the SQL that must give the same rows."""

from catalog import (  # noqa: F401
    model_queries,
    parse_queries,
    rule_queries,
    run_queries,
    state_queries,
    stream_queries,
    view_queries,
    ingest_queries,
)
from catalog.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
