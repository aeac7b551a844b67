"""Wait-event profiles between two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.delta import endpoint_pair
from tidemark.operators.ranking import asc, desc, top_shares
from tidemark.plans.common import grew
from tidemark.plans.statements import TOP_QUERIES, query_statements
from tidemark.repository import Repository

TOP_EVENTS = 10
_KEY = ["dbid", "userid", "queryid", "backend_type", "event_type", "event"]


def _waited(repo: Repository, begin: int, end: int) -> DataFrame:
    pair = endpoint_pair(repo.at("wait_sampling", begin, end), _KEY, begin, end, ["count"])
    return pair.select(*_KEY, grew("count").alias("count")).where(F.col("count") > 0)


def wait_sampling(repo: Repository, begin: int, end: int) -> DataFrame:
    """Main wait events of the statements with the most execution time."""
    statements = query_statements(repo, begin, end, limit=TOP_QUERIES).select(
        "dbid", "userid", "queryid", F.col("datname").alias("database"), F.col("rolname").alias("role"), "query",
        "total_exec_time", "calls",
    )
    # At most TOP_QUERIES rows; keeping only their waits changes no group of the ranking.
    waited = _waited(repo, begin, end).join(F.broadcast(statements), ["dbid", "userid", "queryid"])
    ranked = top_shares(
        waited, ["queryid", "dbid", "userid", "backend_type"], "count", ["event_type", "event"], TOP_EVENTS
    )
    return (
        ranked.orderBy(
            desc("total_exec_time"), desc("calls"), asc("dbid"), asc("userid"), asc("queryid"), asc("row_number"),
            asc("backend_type"),
        )
        .select(
            "queryid", "dbid", "userid", "database", "role", "backend_type", "event_type", "event", "count",
            "ratio", "query", "row_number",
        )
    )


def wait_sampling_by_instance(repo: Repository, begin: int, end: int) -> DataFrame:
    waited = _waited(repo, begin, end).groupBy("event_type", "event").agg(F.sum("count").alias("count"))
    return (
        top_shares(waited, [], "count", ["event_type", "event"], TOP_EVENTS)
        .orderBy("row_number")
        .select("event_type", "event", "count", "ratio", "row_number")
    )


NO_DATABASE = "<global>"


def wait_sampling_by_database(repo: Repository, begin: int, end: int) -> DataFrame:
    waited = (
        _waited(repo, begin, end).groupBy("dbid", "event_type", "event").agg(F.sum("count").alias("count"))
    )
    names = repo.at("database", begin).select("dbid", F.col("name").alias("database"))
    return (
        top_shares(waited, ["dbid"], "count", ["event_type", "event"], TOP_EVENTS)
        .join(names, "dbid", "left")
        .orderBy("dbid", "row_number")
        .select(
            "dbid", F.coalesce("database", F.lit(NO_DATABASE)).alias("database"), "event_type", "event", "count",
            "ratio", "row_number",
        )
    )
