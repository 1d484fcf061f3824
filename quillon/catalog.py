"""Registry of the engine's queries and their SQL oracles."""

from __future__ import annotations

from quillon.plans import aggregations, features, filters, graphs, joins, ledger, metrics, models, scalars, scans, splits, stores, streams, topk, windows  # noqa: F401
from quillon.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
