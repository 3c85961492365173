"""All registered queries: importing a module registers its own."""

from __future__ import annotations

from voltlake.plans import discovery_queries, intake_queries, recording_queries, registry_queries, selection_queries, signal_queries, stream_queries  # noqa: F401
from voltlake.plans.testbed import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
