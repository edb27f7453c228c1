"""All queries of the engine's own operators, and the SQL that checks them."""

from __future__ import annotations

from palimpsest.plans import applied, arms, containing, evaluation, helpers, investigation, lineage, more, ranking, records, said, scalars, segments, stores, trials, turns  # noqa: F401  they register
from palimpsest.plans.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
