"""Retiring snapshots, events and log rows.

The row rules are plain DataFrame filters; :func:`expire_days` applies them to a
stored table by dropping whole day folders and rewriting only the edge day.  All changes are commits
(:mod:`tidemark.versions`), so writers, rewrites and readers may work at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas, versions
from tidemark.repository import Repository, server_of, utc_day


def cutoff(keep_days: int, today: Column | None = None) -> Column:
    """Start of the day ``keep_days`` before today."""
    return F.date_sub(F.current_date() if today is None else today, keep_days).cast("timestamp")


def without_snapshot(df: DataFrame, snapid: int) -> DataFrame:
    return df.where(F.col("snapid") != snapid)


def kept_snapshots(snapshot: DataFrame, before: Column) -> DataFrame:
    return snapshot.where(F.col("time") >= before)


def kept_facts(fact: DataFrame, kept: DataFrame) -> DataFrame:
    """Fact rows of remaining snapshots."""
    return fact.join(kept.select("snapid"), "snapid", "left_semi")


def kept_events(events: DataFrame, table: str, kept: DataFrame) -> DataFrame:
    """Events not older than the oldest remaining snapshot (all, if none remains)."""
    oldest = kept.agg(F.min("time")).scalar()
    at = F.col(schemas.EVENT_TIME[table])
    return events.where(oldest.isNull() | (at >= oldest))


def kept_log(log: DataFrame, before: Column) -> DataFrame:
    return log.where(F.col("timestamp") >= before)


FILES = 4  # files of a server's day that compaction leaves as they are
TRIES = 20

# --- stored tables -----------------------------------------------------------


def _days(spark: SparkSession, root: str, table: str) -> list[date]:
    """Day folders of a table (names only, no data is read)."""
    found = versions.names(spark, f"{root}/{table}")
    dated = [n.removeprefix("date=") for n in found if re.fullmatch(r"date=\d{4}-\d\d-\d\d", n)]
    return sorted(date.fromisoformat(d) for d in dated)


def _day_of(spark: SparkSession, moment: Column) -> date:
    return spark.range(1).select(utc_day(moment)).first()[0]


def rewrite(
    spark: SparkSession,
    root: str,
    table: str,
    folder: str = "",
    keep: Callable[[DataFrame], DataFrame] | None = None,
    drop: Callable[[str], bool] = lambda name: False,
    leave: Callable[[str], bool] = lambda name: False,
) -> None:
    """Replace the batches below a folder by one batch of their kept rows (all without ``keep``).

    Batches whose names ``drop`` takes go unread, those that ``leave`` takes stay as they are.  The exchange is one commit: readers see
    the old batches or the new one.  Batches that others append meanwhile are not on the list and stay; if another
    rewrite took a batch of the list first, this one starts again from what holds then.
    """
    for _ in range(TRIES):
        folders = [f for f in versions.live(spark, root, table, folder) if not leave(_name(f))]
        read = [f for f in folders if not drop(_name(f))]
        added = []
        if read:
            rows = versions.read(spark, root, table, read)
            inside = [c for c in ("date", "server") if c in rows.columns and f"{c}=" in read[0]]
            kept = (rows if keep is None else keep(rows)).withColumn("batch", F.lit(name := versions.new_batch()))
            spread = kept.hint("rebalance", *[F.col(c) for c in inside]) if inside else kept.coalesce(1)
            order = [c for c in ("snapid", "instid", schemas.EVENT_TIME.get(table)) if c in rows.columns]
            spread = spread.sortWithinPartitions(*inside, *order) if inside and order else spread
            versions.write(spread, root, table)
            added = [name]
        if not folders or versions.commit(spark, root, table, gone=folders, added=added):
            return
    raise RuntimeError(f"other rewrites of {table}/{folder} kept coming first")


def _name(folder: str) -> str:
    return folder.rsplit("batch=", 1)[1]


def _of_snapshots(ids: set[int]) -> Callable[[str], bool]:
    return lambda name: name.startswith(versions.SNAPSHOT) and int(name.removeprefix(versions.SNAPSHOT)) in ids


def expire_days(
    spark: SparkSession,
    root: str,
    table: str,
    day: date,
    keep: Callable[[DataFrame], DataFrame] | None = None,
    drop: Callable[[str], bool] = lambda name: False,
    leave: Callable[[str], bool] = lambda name: False,
) -> list[date]:
    """Drop what holds before ``day`` in one commit; filter the folder of ``day`` as :func:`rewrite` does.

    Folders go for good once they have been gone for the grace period, when a later run clears them.
    """
    while True:
        gone = {d: versions.live(spark, root, table, f"date={d.isoformat()}") for d in _days(spark, root, table) if d < day}
        if versions.commit(spark, root, table, gone=[f for folders in gone.values() for f in folders]) if any(gone.values()) else True:
            break
    if keep is not None:
        rewrite(spark, root, table, f"date={day.isoformat()}", keep, drop, leave)
    versions.vacuum(spark, root, table)
    return [d for d, folders in gone.items() if folders]


def compact(spark: SparkSession, root: str, table: str, before: date) -> list[str]:
    """Gather the small files of all days before ``before``: one server folder after the other.

    Such a day must be closed: no stream will write one of its batches again.  Facts of snapshots that are not published are left
    alone, as they may still be written.  The dimensions have no days and are gathered whole.
    """
    if table in schemas.UNDATED:
        rewrite(spark, root, table)
        versions.vacuum(spark, root, table)
        return [table]
    published = Repository(spark, path=root).table("snapshot").select("snapid", utc_day(F.col("time")).alias("d"))
    done = []
    for day in (d for d in _days(spark, root, table) if d < before):
        ids: set[int] | None = None
        for server in versions.names(spark, f"{root}/{table}/date={day.isoformat()}"):
            folder = f"date={day.isoformat()}/{server}"
            live = versions.live(spark, root, table, folder)
            if sum(len(versions.names(spark, f"{root}/{table}/{f}")) for f in live) <= FILES:
                continue
            if ids is None:  # snapshots of one day
                ids = {r.snapid for r in published.where(F.col("d") == F.lit(day)).select("snapid").collect()}
            known = _of_snapshots(ids)
            rewrite(spark, root, table, folder, leave=lambda n, known=known: n.startswith(versions.SNAPSHOT) and not known(n))
            done.append(f"{table}/{folder}")
    versions.vacuum(spark, root, table)
    return done


def del_snapshot(spark: SparkSession, root: str, snapid: int) -> None:
    """Delete one snapshot: its row first, so readers stop seeing it, then its facts.

    Facts that lie in the snapshot's own batch go without being read; only gathered batches of its day and server are
    written anew.  Snapshots that others write or publish meanwhile stay.
    """
    repo = Repository(spark, path=root)
    mark = repo.table("snapshot").where(F.col("snapid") == snapid)
    found = mark.select(utc_day(F.col("time")).cast("string").alias("d"), server_of(F.col("instid")).alias("s")).first()
    if found is None:
        return
    rewrite(spark, root, "snapshot", keep=lambda df: without_snapshot(df, snapid))
    own = _of_snapshots({snapid})
    for table in schemas.snapshot_facts():
        rewrite(
            spark, root, table, f"date={found['d']}/server={found['s']}", lambda df: without_snapshot(df, snapid),
            drop=own, leave=lambda n: n.startswith(versions.SNAPSHOT) and not own(n),
        )
        versions.vacuum(spark, root, table)


def del_snapshots_before(spark: SparkSession, root: str, before: datetime) -> None:
    """Delete snapshots older than ``before`` with their facts, then orphaned events."""
    moment = F.lit(before).cast("timestamp")
    day = _day_of(spark, moment)
    old = Repository(spark, path=root).table("snapshot").where((utc_day(F.col("time")) == F.lit(day)) & (F.col("time") < moment))
    retired = _of_snapshots({r.snapid for r in old.select("snapid").collect()})  # at most those of one day
    rewrite(spark, root, "snapshot", keep=lambda df: kept_snapshots(df, moment))
    kept = Repository(spark, path=root).table("snapshot")
    for table in schemas.snapshot_facts():
        expire_days(
            spark, root, table, day, lambda df: kept_facts(df, kept),
            drop=retired, leave=lambda n: n.startswith(versions.SNAPSHOT) and not retired(n),
        )
    oldest = kept.agg(F.min("time").alias("t"), F.min(utc_day(F.col("time"))).alias("d")).first()
    if oldest["t"] is None:
        return
    for table, at in schemas.EVENT_TIME.items():
        if table != "log":
            expire_days(spark, root, table, oldest["d"], lambda df, at=at: df.where(F.col(at) >= F.lit(oldest["t"])))


def del_repolog(spark: SparkSession, root: str, before: datetime) -> None:
    moment = F.lit(before).cast("timestamp")
    expire_days(spark, root, "log", _day_of(spark, moment), lambda df: kept_log(df, moment))
