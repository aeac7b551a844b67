"""Reports of many servers in one job.

The scopes are a frame ``(instid, begin, end)``, one row per server, as :func:`tidemark.plans.catalogue.report_scope_by_snapid`
gives them.  Facts meet their servers' endpoints by one join, and a dynamic filter on folders is planned (it does
not prune yet, see README), so neither plans nor driver work grow with the number of servers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.delta import endpoint_pair, registry
from tidemark.operators.ranking import asc
from tidemark.plans import databases, relations, statements
from tidemark.plans.common import grew
from tidemark.repository import Repository, server_of, utc_day

# Folder names are 12 bytes or so a row; a repository of ten years has some 470 000.
BROADCAST_FOLDERS = 1_000_000


class Fleet:
    """Pruned reads of the scopes' facts; rows bear ``instid``, ``begin`` and ``end`` of their server."""

    def __init__(self, repo: Repository, scopes: DataFrame) -> None:
        self.repo = repo
        # the comparison also tells the optimizer that the scopes are worth pruning by
        self.scopes = scopes.where(F.col("begin") != F.col("end")).select("instid", "begin", "end")
        snaps = repo.table("snapshot").select("snapid", "instid", "time")
        self.timeline = snaps.join(self.scopes, "instid").where(F.col("snapid").between(F.col("begin"), F.col("end")))

    def _read(self, name: str, marks: DataFrame) -> DataFrame:
        frame = self.repo._stored(name)
        if self.repo._partitioned(frame):
            folders = marks.select(utc_day(F.col("time")).alias("date"), server_of(F.col("instid")).alias("server")).distinct()
            few = folders.limit(BROADCAST_FOLDERS + 1).count() <= BROADCAST_FOLDERS
            frame = frame.join(F.broadcast(folders) if few else folders, ["date", "server"], "left_semi")
        frame = self.repo._logical(name, frame)
        return frame.join(marks.drop("time"), "snapid")

    def at(self, name: str, begin: bool = True, end: bool = True) -> DataFrame:
        """Rows of a fact at the first and the last snapshots of the scopes, or at one of them."""
        here = F.lit(False)
        if begin:
            here = here | (F.col("snapid") == F.col("begin"))
        if end:
            here = here | (F.col("snapid") == F.col("end"))
        return self._read(name, self.timeline.where(here))

    def scoped(self, name: str) -> DataFrame:
        """Rows of a fact at all snapshots of the scopes."""
        return self._read(name, self.timeline)

    def pair(self, name: str, keys: list[str], *columns, **more) -> DataFrame:
        """One row per server and entity, as :func:`endpoint_pair` makes for one server."""
        return endpoint_pair(self.at(name), ["instid", *keys], F.col("begin"), F.col("end"), *columns, **more)

    def timed(self, df: DataFrame) -> DataFrame:
        """Add the times of both ends; a server whose first or last snapshot is missing drops out."""
        when = lambda side: F.max(F.when(F.col("snapid") == F.col(side), F.col("time"))).alias(f"{side}_time")
        times = self.timeline.groupBy("instid").agg(when("begin"), when("end"))
        return df.join(times.where("begin_time IS NOT NULL AND end_time IS NOT NULL"), "instid")


def dbstats(fleet: Fleet) -> DataFrame:
    pair = fleet.pair("database", ["dbid"], databases.STATS, at_end=["name"])
    return fleet.timed(pair).select("instid", *databases.stats_columns())


def query_statements(fleet: Fleet, limit: int | None = None) -> DataFrame:
    """Statements of each scope, the ``limit`` longest of every server if given."""
    keys = ["instid", "dbid", "userid", "queryid"]
    seen = registry(fleet.scoped("statement"), keys, F.col("begin"), statements.COUNTERS, texts=["query"])
    seen = seen.where((grew("calls") > 0) & (grew("total_exec_time") > 0))
    database = fleet.at("database", end=False).select("instid", "dbid", F.col("name").alias("datname"))
    role = fleet.at("role", end=False).select("instid", "userid", F.col("name").alias("rolname"))
    named = seen.join(database, ["instid", "dbid"]).join(role, ["instid", "userid"])
    report = named.select("instid", *statements.statement_columns())
    if limit is not None:
        # a rank filter becomes a group limit before the shuffle
        place = F.row_number().over(Window.partitionBy("instid").orderBy(*statements._statement_order()))
        report = report.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")
    return report


def schema_info_tables(fleet: Fleet) -> DataFrame:
    pair = fleet.pair("table", ["dbid", "nsp", "tbl"], relations.SCHEMA_COUNTERS, at_end=["name", "n_live_tup"])
    names: Callable[[str, str, list[str]], DataFrame] = lambda name, alias, keys: (
        fleet.at(name, begin=False).select("instid", *keys, F.col("name").alias(alias))
    )
    tables = (
        pair.withColumnRenamed("e_name", "table")
        .join(names("database", "database", ["dbid"]), ["instid", "dbid"])
        .join(names("schema", "schema", ["dbid", "nsp"]), ["instid", "dbid", "nsp"])
        .where(relations._visible(fleet.repo, own=True))
    )
    columns = fleet.at("column", begin=False).groupBy("instid", "dbid", "tbl").agg(F.count(F.lit(1)).alias("attnum"))
    report = tables.join(columns, ["instid", "dbid", "tbl"], "left")
    return report.orderBy(asc("instid"), *relations._name_order()).select("instid", *relations.schema_columns())


REPORTS: dict[str, Callable[[Fleet], DataFrame]] = {
    "dbstats": dbstats,
    "query_statements": query_statements,
    "schema_info_tables": schema_info_tables,
}
