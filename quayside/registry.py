"""All queries of the engine by name."""

from __future__ import annotations

from quayside.plans.oracle import oracle_sql
from quayside.plans.queries import queries

__all__ = ["oracle_sql", "queries"]
