"""All analytics queries and their DuckDB oracles; importing the modules registers them."""

from __future__ import annotations

from tessella.plans import agent_queries, match_queries, retrieval_queries, score_queries, text_queries, value_queries  # noqa: F401
from tessella.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
