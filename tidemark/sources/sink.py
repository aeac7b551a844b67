"""Writing repository tables: day partitions, snapshot ids, publish-last visibility."""

from __future__ import annotations

import os
import time as clock
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas, versions
from tidemark.plans.alerts import RULES, alerts, as_log_rows, carried_state, state_batch
from tidemark.repository import Repository, _exists, server_of, utc_day

# facts kept only for databases that the snapshot knows
GUARDED = ("statement", "plan", "rusage")
CLAIMS = "_snapshot_claim"
CLAIMS_KEPT = 100  # more than writers that claim at the same moment


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of ``table`` in order and type; missing ones are NULL."""
    return df.select(*_columns(df, table))


def _columns(df: DataFrame, table: str, but: tuple[str, ...] = ()) -> list[Column]:
    columns = []
    for f in schemas.struct(table).fields:
        if f.name not in but:
            value = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)
            columns.append(value.cast(f.dataType).alias(f.name))
    return columns


def stamped(df: DataFrame, snapid: int, day: Column | None = None) -> DataFrame:
    """Put the snapshot id, and the partition date if given, on collected rows."""
    df = df.withColumn("snapid", F.lit(snapid).cast("bigint"))
    return df if day is None else df.withColumn("date", day.cast("date"))


def known_databases(df: DataFrame, database: DataFrame) -> DataFrame:
    """Rows whose database belongs to their snapshot."""
    return df.join(database.select("snapid", "dbid"), ["snapid", "dbid"], "left_semi")


def append_fact(df: DataFrame, root: str, table: str, day: Column, instid: int | Column, batch: str | None = None) -> None:
    """Append rows of a snapshot fact to the folder of their UTC day, server bucket and batch.

    Without the name of a snapshot's batch the rows show all at once, when they are committed.  Rebalancing makes one
    file of a small snapshot and splits a large one; files are sorted for row-group skipping.
    """
    owner = F.lit(instid) if isinstance(instid, int) else instid
    name = versions.new_batch() if batch is None else batch
    place = df.withColumns({"date": day.cast("date"), "server": server_of(owner)})
    rows = place.select(*_columns(place, table, but=("date",)), "date", "server", F.lit(name).alias("batch"))
    rows = rows.hint("rebalance").sortWithinPartitions("date", "server", "snapid")
    versions.write(rows, root, table)
    if batch is None:
        versions.commit(df.sparkSession, root, table, added=[name])


def append_events(df: DataFrame, root: str, table: str, batch: str | None = None) -> None:
    """Write event rows to the folder of their own UTC day, server bucket and batch.

    A named batch that is written again replaces itself, so a retried micro-batch is stored once; without a name the
    rows are a batch of their own.  Rebalancing gathers a day's rows for few files but lets adaptive
    execution split a day (or a whole micro-batch) that is too large for one task.
    """
    at = schemas.EVENT_TIME[table]
    rows = conform(df, table).withColumns(
        {
            "date": utc_day(F.col(at)),
            "server": server_of(F.coalesce("instid", F.lit(0))),
            "batch": F.lit(uuid.uuid4().hex if batch is None else batch),
        }
    )
    spread = rows.hint("rebalance", F.col("date"), F.col("server")).sortWithinPartitions("date", "server", "instid", at)
    versions.write(spread, root, table)


def append_dimension(df: DataFrame, root: str, table: str) -> None:
    """Append rows of a dimension as one file, which shows at once and whole."""
    rows = conform(df, table).withColumn("batch", F.lit(f"d-{uuid.uuid4().hex}")).coalesce(1)
    versions.write(rows, root, table)


def append_text(lines: DataFrame, path: str, batch: str | None = None) -> None:
    """Write text lines to the folder of their batch; a named batch replaces itself."""
    lines.write.mode("overwrite").text(f"{path}/batch={uuid.uuid4().hex if batch is None else batch}")


# --- snapshots ---------------------------------------------------------------


@dataclass(frozen=True)
class Snapshot:
    snapid: int
    alerts: int


def _bytes(spark: SparkSession, folders: list[str]) -> int:
    """Size of a few folders; the rest of the repository is not looked at."""
    total = 0
    for folder in folders:
        fs, path = versions.open_path(spark, folder)
        total += int(fs.getContentSummary(path).getLength()) if fs.exists(path) else 0
    return total


def _created(fs, path) -> bool:
    """Create an empty file unless it is there; of several writers one succeeds."""
    if fs.getScheme() != "file":
        return fs.createNewFile(path)
    try:  # Hadoop's local file system looks first and creates then
        os.close(os.open(path.toUri().getPath(), os.O_CREAT | os.O_EXCL))
    except FileExistsError:
        return False
    return True


def claim_snapshot(spark: SparkSession, root: str) -> int:
    """Reserve the next snapshot id; several writers may claim at once.

    A claim is a file named by its id, created only if it is not there.  Claims are kept apart from published
    snapshots: a run that dies leaves rows under an id no reader ever sees and no later run takes again.  Of claims only
    the newest matter, so older files are removed.
    """
    fs, folder = versions.open_path(spark, f"{root}/{CLAIMS}")
    fs.mkdirs(folder)
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    taken = sorted(int(n) for n in names if n.isdigit())
    last = taken[-1] if taken else 0
    if not taken and _exists(spark, f"{root}/snapshot"):
        published = Repository(spark, path=root).table("snapshot")
        last = published.agg(F.max("snapid")).first()[0] or 0
    snapid = last + 1
    while not _created(fs, versions.open_path(spark, f"{root}/{CLAIMS}/{snapid}")[1]):
        snapid += 1
    for old in taken[:-CLAIMS_KEPT]:
        fs.delete(versions.open_path(spark, f"{root}/{CLAIMS}/{old}")[1], False)
    return snapid


def append_snapshot(
    spark: SparkSession,
    root: str,
    instid: int,
    at: datetime,
    facts: Mapping[str, DataFrame],
    comment: str = "",
    xid_current: int | None = None,
    rules: Mapping = RULES,
    alerts_to_log: bool = False,
) -> Snapshot:
    """Write all facts of one snapshot, judge alerts, then publish the snapshot row.

    Readers join facts to published snapshots, so a partial snapshot is invisible.
    """
    started = clock.monotonic()
    snapid = claim_snapshot(spark, root)
    row = _snapshot_row(spark, snapid, instid, at, comment, xid_current)
    place = row.select(utc_day(F.col("time")).cast("string"), server_of(F.col("instid"))).first()
    batch, said = f"{versions.SNAPSHOT}{snapid}", f"alerts-{snapid}"
    day = F.lit(place[0]).cast("date")
    database = stamped(facts["database"], snapid) if "database" in facts else None
    for name, rows in facts.items():
        rows = stamped(rows, snapid)
        if name in GUARDED and database is not None:
            rows = known_databases(rows, database)
        append_fact(rows, root, name, day, instid, batch)
    found = _judge(spark, root, row, snapid, rules)
    append_fact(found, root, "alert_message", day, instid, batch)
    repo = Repository(spark, {"snapshot": row}, path=root)
    state = conform(carried_state(repo, snapid, instid), "alert_state").withColumn("batch", F.lit(state_batch(instid)))
    versions.write(state.coalesce(1), root, "alert_state")  # in place of the one before
    stored = repo.at("alert_message", snapid)  # from its own folder
    if alerts_to_log:
        shown = Repository(spark, {"snapshot": row})
        append_events(as_log_rows(stored, shown), root, "log", said)
    own = [(name, batch) for name in (*facts, "alert_message")] + [("log", said)]
    size = _bytes(spark, [f"{root}/{name}/date={place[0]}/server={place[1]}/batch={b}" for name, b in own])
    finished = row.withColumns(
        {
            "exec_time": F.lit(int((clock.monotonic() - started) * 1_000_000)).cast("bigint"),
            "snapshot_increase_size": F.lit(size).cast("bigint"),
        }
    )
    append_dimension(finished, root, "snapshot")
    return Snapshot(snapid, stored.count())


def _snapshot_row(spark, snapid, instid, at, comment, xid_current) -> DataFrame:
    fields = [f for f in schemas.struct("snapshot").fields if f.name not in ("exec_time", "snapshot_increase_size")]
    values = [(snapid, instid, at, comment, None)]
    row = spark.createDataFrame(values, T.StructType(fields))
    xid = F.lit(None if xid_current is None else str(xid_current)).cast("decimal(20,0)")
    return conform(row.withColumn("xid_current", xid), "snapshot")


def _judge(spark: SparkSession, root: str, row: DataFrame, snapid: int, rules: Mapping) -> DataFrame:
    """Alert messages of the snapshot being written, which is not published yet."""
    published = Repository(spark, path=root)
    current = Repository(
        spark, {"snapshot": published.table("snapshot").unionByName(row)}, path=root
    )
    return alerts(current, snapid, snapid, rules).select("snapid", "message")
