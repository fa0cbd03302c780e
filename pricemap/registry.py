"""Every query of the comparison engine with its DuckDB twin."""

from __future__ import annotations

from pricemap.plans import field_queries  # noqa: F401  (registers its queries)
from pricemap.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
