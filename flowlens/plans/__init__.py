"""Registered queries: the operators over the driver's tables, each with its SQL twin."""

from flowlens.plans import job_queries, manifest_queries, store_queries, telemetry_queries  # noqa: F401
from flowlens.plans.registry import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS"]
