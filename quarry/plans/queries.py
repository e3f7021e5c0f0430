"""All queries: importing the modules registers theirs."""

from __future__ import annotations

from quarry.plans import catalog, code_parts, figure_plans, figures, graphs, models, records, retrieval, stores  # noqa: F401
from quarry.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
