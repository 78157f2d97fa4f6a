"""Registered queries; importing this package fills the registry."""

from vacantia.plans import catalogue_queries, funnel_queries, lifecycle_queries, ranking_queries, scoring_queries, source_queries, stream_queries, text_queries  # noqa: F401
from vacantia.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
