"""All registered queries."""

from __future__ import annotations

from riskframe.plans import (  # noqa: F401  (importing registers the queries)
    analytics_catalog,
    columns_catalog,
    joins_catalog,
    models_catalog,
    sources_catalog,
    stats_catalog,
)
from riskframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
