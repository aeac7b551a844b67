"""Tidemark: snapshot-counter analytics on Spark.

Monitored servers leave cumulative counters behind ("tide marks").  This
package stores those marks as partitioned Parquet and turns pairs and series of
them into rates, deltas, rankings, alerts and event reports with the DataFrame
API.
"""

from tidemark.repository import Repository
from tidemark.session import build_session, tune

__all__ = ["Repository", "build_session", "tune"]
