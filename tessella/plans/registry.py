"""Queries of the library and their SQL."""

from __future__ import annotations

from tessella.plans import engines, kernels  # noqa: F401  (register their queries)
from tessella.plans.catalog import ORACLE, QUERIES

FLAGSHIP = "match_float_mnn_ratio"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
