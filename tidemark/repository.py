"""Access to repository tables with snapshot-, instance- and date-pruned reads.

Layout on disk (written by :mod:`tidemark.sources.sink`)::

    <root>/<table>/date=YYYY-MM-DD/server=N/batch=B/*.parquet   snapshot facts and events
    <root>/<dimension>/batch=B/*.parquet                        instance, snapshot, alert, ...
    <root>/_commits/<table>/                                    which batches hold: :mod:`tidemark.versions`

``date`` is the UTC day and ``server`` the instance's bucket, both taken from absolute values, so
readers and writers in any session time zone agree.  Files are sorted by ``snapid`` (facts) or
event time: a filter prunes whole folders first and row groups second.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas, versions

# One scope of snapshots has at most (end - begin + 1) rows because snapid is
# unique; up to this many (id, instance, time) rows are a few MiB to broadcast.
# Longer scopes are left to the optimizer, which joins by shuffle and splits skew.
BROADCAST_SNAPSHOTS = 100_000

# Folders that the servers of one day are spread over; a report reads one of them.
SERVERS = 128

# Schemas that belong to the server itself.
CATALOG_SCHEMAS = ("pg_catalog", "pg_toast", "information_schema")


def utc_day(time: Column) -> Column:
    """Day of a timestamp in UTC, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(time) / 86_400_000_000).cast("int"))


def server_of(instid: Column) -> Column:
    """Bucket of an instance."""
    return F.pmod(instid, F.lit(SERVERS)).cast("int")


@dataclass(frozen=True)
class Bounds:
    """Lazy scalar columns of a scope: its instance and its first and last time."""

    instid: Column
    start: Column
    end: Column


class Repository:
    def __init__(
        self,
        spark: SparkSession,
        tables: Mapping[str, DataFrame] | None = None,
        path: str | None = None,
        own_schema: str = "tidemark",
    ) -> None:
        self.spark = spark
        self.path = path
        self.own_schema = own_schema
        self._frames = dict(tables or {})

    # -- raw tables ---------------------------------------------------------

    def table(self, name: str) -> DataFrame:
        """Whole table; an absent table reads as empty."""
        return self._logical(name, self._stored(name))

    def _stored(self, name: str) -> DataFrame:
        frame = self._frames.get(name)
        if frame is None:
            frame = self._frames[name] = self._open(name)
        return frame

    def _open(self, name: str) -> DataFrame:
        location = f"{self.path}/{name}" if self.path else None
        if location is None or not _exists(self.spark, location):
            return self.spark.createDataFrame([], schemas.struct(name))
        version = versions.current(self.spark, self.path, name)  # before the files are listed
        frame = self.spark.read.schema(schemas.stored_struct(name)).parquet(location)
        return frame.where(version.visible(frame.columns))

    @staticmethod
    def _logical(name: str, frame: DataFrame) -> DataFrame:
        """Hide partition columns that the table's schema does not have."""
        if name in schemas.DDL:
            known = schemas.column_names(name)
            frame = frame.drop(*[c for c in ("date", "server", "batch") if c in frame.columns and c not in known])
        return frame

    # -- scope --------------------------------------------------------------

    def instance_of(self, snapid: int) -> Column:
        snap = self.table("snapshot").where(F.col("snapid") == snapid)
        return snap.agg(F.max("instid")).scalar()

    def timeline(self, begin: int, end: int, instance_of: int | None = None) -> DataFrame:
        """``snapid, instid, time`` of one instance's snapshots in ``[begin, end]``."""
        snap = (
            self.table("snapshot")
            .where(F.col("snapid").between(begin, end))
            .where(F.col("instid") == self.instance_of(end if instance_of is None else instance_of))
            .select("snapid", "instid", "time")
        )
        return F.broadcast(snap) if end - begin < BROADCAST_SNAPSHOTS else snap

    def bounds(self, begin: int, end: int) -> Bounds:
        """First time at or after ``begin`` and last time at or before ``end`` of the instance."""
        mine = self.table("snapshot").where(F.col("instid") == self.instance_of(end))
        ends = F.struct(
            F.max("instid").alias("instid"),
            F.min(F.when(F.col("snapid") >= begin, F.col("time"))).alias("start"),
            F.max(F.when(F.col("snapid") <= end, F.col("time"))).alias("end"),
        )
        scope = mine.agg(ends).scalar()  # one subquery for all three
        return Bounds(scope["instid"], scope["start"], scope["end"])

    # -- pruned reads -------------------------------------------------------

    def _partitioned(self, frame: DataFrame) -> bool:
        return self.path is not None and "date" in frame.columns and "server" in frame.columns

    def at(self, name: str, *snapids: int) -> DataFrame:
        """Rows of a fact at the given snapshots, from exactly their days and servers and no other snapshot's batch."""
        frame = self._stored(name)
        if self._partitioned(frame):
            own = F.col("batch").isin(*[f"{versions.SNAPSHOT}{s}" for s in snapids])
            frame = frame.where(own | ~F.col("batch").startswith(versions.SNAPSHOT))
            here = F.lit(False)
            for snapid in dict.fromkeys(snapids):
                mark = self._mark(F.col("snapid") == snapid)
                here = here | ((F.col("date") == mark["first"]) & (F.col("server") == mark["server"]))
            frame = frame.where(here)
        return self._logical(name, frame.where(F.col("snapid").isin(*snapids)))

    def between(self, name: str, begin: int | Column, end: int | Column) -> DataFrame:
        """Rows of a fact in a snapshot range, of all servers; a bound may be a scalar subquery."""
        wanted = F.col("snapid").between(begin, end)
        frame = self._stored(name)
        if self._partitioned(frame):
            days = self._mark(wanted)
            frame = frame.where(F.col("date").between(days["first"], days["last"]))
        return self._logical(name, frame.where(wanted))

    def ranged(self, name: str, begin: int, end: int) -> DataFrame:
        """Rows of a fact in a snapshot range, from the folders of the server of ``end``.

        Other servers of its bucket are still in it; join with :meth:`timeline`, or use :meth:`scoped`.
        """
        wanted = F.col("snapid").between(begin, end)
        frame = self._stored(name)
        if self._partitioned(frame):
            days = self._mark(wanted & (F.col("instid") == self.instance_of(end)))
            frame = frame.where(F.col("date").between(days["first"], days["last"]) & (F.col("server") == days["server"]))
        return self._logical(name, frame.where(wanted))

    def scoped(self, name: str, begin: int, end: int) -> DataFrame:
        """Rows of a fact at the snapshots of the scope's instance only."""
        return self.ranged(name, begin, end).join(self.timeline(begin, end).select("snapid"), "snapid", "left_semi")

    def _mark(self, wanted: Column) -> Column:
        """First and last UTC day and the server bucket of wanted snapshots, as one scalar subquery.

        It is known before the fact's files are listed, so other folders are never opened.
        """
        day = utc_day(F.col("time"))
        mark = F.struct(F.min(day).alias("first"), F.max(day).alias("last"), F.max(server_of(F.col("instid"))).alias("server"))
        return self.table("snapshot").where(wanted).agg(mark).scalar()

    def events(self, name: str, begin: int, end: int) -> DataFrame:
        """Event rows of the scope's instance inside its time range, ends included."""
        at = F.col(schemas.EVENT_TIME[name])
        scope = self.bounds(begin, end)
        frame = self._stored(name)
        if self._partitioned(frame):
            frame = frame.where(
                F.col("date").between(utc_day(scope.start), utc_day(scope.end)) & (F.col("server") == server_of(scope.instid))
            )
        frame = frame.where(at.between(scope.start, scope.end) & (F.col("instid") == scope.instid))
        return self._logical(name, frame)

    # -- derived dimensions -------------------------------------------------

    def snap_date(self, snapid: int) -> DataFrame:
        """Date of one snapshot."""
        snap = self.table("snapshot").where(F.col("snapid") == snapid)
        return snap.select(F.to_date("time").alias("snap_date"))

    def user_schemas(self, own: bool = False, toast: bool = False) -> tuple[str, ...]:
        """Schema names that reports leave out."""
        hidden = [s for s in CATALOG_SCHEMAS if not (toast and s == "pg_toast")]
        return tuple(hidden + ([self.own_schema] if own else []))


def _exists(spark: SparkSession, location: str) -> bool:
    if "://" not in location:
        return os.path.isdir(location)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)
