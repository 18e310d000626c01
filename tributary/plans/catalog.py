"""All registered queries: importing the query modules registers them."""

from __future__ import annotations

from tributary.plans import queries_models, queries_records  # noqa: F401
from tributary.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
