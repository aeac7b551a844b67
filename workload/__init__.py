"""Queries over the shared test tables: Spark reports next to DuckDB SQL."""

from workload import alerts, fleet, ingest, logs, reports_a, reports_b, stored  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
