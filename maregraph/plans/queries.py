"""All queries of the time-series engine with their SQL."""

from __future__ import annotations

from maregraph.plans import causal, classical, evaluation, learned  # noqa: F401
from maregraph.plans.registry import QUERIES, SQL


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["QUERIES", "oracle_sql"]
