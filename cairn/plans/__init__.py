"""Registered queries of the cohort engine and their SQL."""

from cairn.plans import analysis_queries, release_queries, service_queries  # noqa: F401
from cairn.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
