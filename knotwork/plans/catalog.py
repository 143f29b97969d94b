"""All registered queries."""

from __future__ import annotations

from knotwork.plans import embedding_queries, feature_queries, graph_queries, learning_queries, source_queries, triple_queries, vector_queries  # noqa: F401  (register)
from knotwork.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
