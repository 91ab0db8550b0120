"""Queries over the driver's tables; importing the package fills the registry."""

from graphlens.plans import context_queries, delivery_queries, gold_queries, graph_queries, guard_queries, ladder_queries, ledger_queries, lookup_queries, overload_queries, search_queries, store_queries, stream_queries, telemetry_queries, text_queries  # noqa: F401
from graphlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
