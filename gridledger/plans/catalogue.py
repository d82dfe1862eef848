"""Imports every query module, so that the registry is complete."""

from gridledger.plans import (  # noqa: F401
    blocks_relational,
    blocks_rows,
    blocks_sources,
    carriers,
    commissioning,
    districts,
    overview,
    series,
    streams,
    topical,
    traffic,
)
from gridledger.plans.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
