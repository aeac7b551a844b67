"""Round trips through stored tables: written below the shared folder, read back through the repository."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tidemark import Repository, schemas
from tidemark.repository import utc_day
from tidemark.sources import collect, logfile, retention, sink
from workload.oracle import B, E, big, full
from workload.registry import add


_LOCAL: list[str] = []


def _root(spark) -> str:
    """A new folder in the shared folder that the cluster names; a temporary one only where one process runs all (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="stored-"))
        shared = _LOCAL[0]
    return f"{shared.rstrip('/')}/repo-{uuid.uuid4().hex}"


def _with_snapshot(r, name: str):
    marks = r.table("snapshot").select("snapid", "instid", "time")
    return r.table(name).join(marks, "snapid")


def _stored(r, *facts: str) -> Repository:
    """The derived snapshots and some of their facts as stored tables."""
    root = _root(r.spark)
    sink.append_dimension(r.table("instance"), root, "instance")
    for name in facts:
        sink.append_fact(_with_snapshot(r, name), root, name, utc_day(F.col("time")), F.col("instid"))
    sink.append_dimension(r.table("snapshot"), root, "snapshot")
    return Repository(r.spark, path=root)


def _sql(table: str, columns: list[str] | None = None) -> str:
    """DuckDB columns of a frame in portable types."""
    out = []
    for field in schemas.DDL[table].replace("(20,0)", "").replace("(30,0)", "").split(", "):
        column, kind = field.split(" ")
        name = f'"{column}"'
        if columns is not None and column not in columns:
            continue
        if kind in ("int", "smallint", "bigint"):
            out.append(f"{big(name)} AS {name}")
        elif kind in ("float", "double", "decimal"):
            out.append(f"CAST({name} AS DOUBLE) AS {name}")
        elif kind == "timestamp":
            out.append(f"{full(name)} AS {name}")
        elif kind.startswith("array"):
            out.append(f"array_to_string({name}, ',') AS {name}")
        else:
            out.append(name)
    return ", ".join(out)


# --- plain projections --------------------------------------------------------
# Columns of each landed view (the derived frames hold no others).
PLAIN = {
    "replication_slots": "snapid slot_name plugin slot_type datoid active_pid",
    "stat_replication_slots": "snapid slot_name spill_txns spill_count spill_bytes stream_txns stream_count stream_bytes total_txns total_bytes",
    "stat_io": "snapid backend_type object context reads writes fsyncs",
    "stat_wal": "snapid wal_records wal_fpi wal_bytes wal_write wal_sync",
    "archive": "snapid archived_count failed_count",
    "wait_sampling": "snapid dbid userid queryid backend_type event_type event count",
    "xact": "snapid client pid duration query",
    "tablespace": "snapid name location avail total",
    "cpu": "snapid cpu_id cpu_user cpu_system cpu_idle cpu_iowait",
    "device": "snapid device_name device_readsector device_writesector",
    "loadavg": "snapid loadavg1 loadavg5 loadavg15",
    "memory": "snapid memfree buffers cached swap dirty",
    "profile": "snapid processing execute",
}
for _table, _names in PLAIN.items():
    _names = _names.split()
    add(
        f"ingest_plain_{_table}",
        lambda r, t=_table, n=_names: collect.ingest_plain(r.table(t), t, ("snapid",)).select(*n),
        f'SELECT {_sql(_table, _names)} FROM "{_table}"',
    )

# --- sinks and pruned reads ----------------------------------------------------
_DB = ["snapid", "dbid", "name", "size", "xact_commit", "blks_hit"]
add(
    "append_fact_round_trip",
    lambda r: _stored(r, "database").table("database").select(*_DB),
    f"SELECT {_sql('database', _DB)} FROM database",
)
add(
    "append_fact_stamped",
    lambda r: _stored(r, "table").table("table").select("snapid", "dbid", "tbl", "date"),
    """SELECT t.snapid, dbid, CAST(tbl AS BIGINT) AS tbl, CAST(CAST(time AS DATE) AS VARCHAR) AS date FROM "table" t JOIN snapshot USING (snapid)""",
)
add(
    "stamped_rows",
    lambda r: sink.stamped(r.table("x_db").select("dbid", "d", "instid", "n"), 77, F.make_date(F.lit(2024), F.lit(1), F.col("d").cast("int"))),
    "SELECT dbid, d, instid, n, CAST(77 AS BIGINT) AS snapid, CAST(make_date(2024, 1, d) AS VARCHAR) AS date FROM x_db",
)
add(
    "stored_pair_read",
    lambda r: _stored(r, "database").at("database", B, E).select(*_DB),
    f"SELECT {_sql('database', _DB)} FROM database WHERE snapid IN ({B}, {E})",
)
add(
    "stored_scope_read",
    lambda r: _stored(r, "database").scoped("database", B, E).select(*_DB),
    f"SELECT {_sql('database', _DB)} FROM database JOIN o_scope USING (snapid)",
)


def _stored_events(r, table: str) -> Repository:
    repo = _stored(r)
    for batch in ("first", "second", "first"):  # a batch that comes again is stored once
        half = F.pmod(F.crc32(F.col("table").cast("binary")), F.lit(2)) == int(batch == "second")
        sink.append_events(r.table(table).where(half), repo.path, table, batch)
    return repo


_EVENT = ["instid", "start", "database", "schema", "table", "page_hit", "duration"]
add(
    "event_sink_round_trip",
    lambda r: _stored_events(r, "autovacuum").table("autovacuum").select(*_EVENT),
    f"SELECT {_sql('autovacuum', _EVENT)} FROM autovacuum",
)


def _compacted(r):
    repo = _stored_events(r, "autoanalyze")
    retention.compact(r.spark, repo.path, "autoanalyze", retention._day_of(r.spark, F.lit("2100-01-01").cast("timestamp")))
    return Repository(r.spark, path=repo.path).table("autoanalyze")


add("compacted_events", lambda r: _compacted(r).select(*_EVENT), f"SELECT {_sql('autoanalyze', _EVENT)} FROM autoanalyze")


def _retired(r):
    repo = _stored(r, "database")
    retention.del_snapshot(r.spark, repo.path, E)
    return Repository(r.spark, path=repo.path).table("database").select(*_DB)


add("stored_del_snapshot", _retired, f"SELECT {_sql('database', _DB)} FROM database WHERE snapid <> {E}")


def _expired(r):
    """Facts from the day of the scope's end on, by whole day folders; nothing of that day is filtered."""
    repo = _stored(r, "database")
    last = r.table("snapshot").where(F.col("snapid") == E).select(utc_day(F.col("time"))).first()[0]
    retention.expire_days(r.spark, repo.path, "database", last)
    return Repository(r.spark, path=repo.path).table("database").select(*_DB)


_LAST = f"(SELECT time FROM snapshot WHERE snapid = {E})"
add(
    "stored_expire_days",
    _expired,
    f"SELECT {_sql('database', _DB)} FROM database JOIN (SELECT snapid FROM snapshot WHERE CAST(time AS DATE) >= CAST({_LAST} AS DATE)) USING (snapid)",
)


def _retired_before(r):
    repo = _stored(r, "database")
    moment = r.table("snapshot").where(F.col("snapid") == E).first()["time"]
    retention.del_snapshots_before(r.spark, repo.path, moment)
    return Repository(r.spark, path=repo.path).table("database").select(*_DB)


add(
    "stored_del_snapshots_before",
    _retired_before,
    f"SELECT {_sql('database', _DB)} FROM database JOIN (SELECT snapid FROM snapshot WHERE time >= {_LAST}) USING (snapid)",
)


def _appended(r) -> Repository:
    """The facts of the scope's end written as the first snapshot of a new repository."""
    root = _root(r.spark)
    mark = r.table("snapshot").where(F.col("snapid") == E).first()
    facts = {name: r.table(name).where(F.col("snapid") == E) for name in ("database", "statement")}
    sink.append_snapshot(r.spark, root, mark["instid"], mark["time"], facts, comment="again", rules={})
    return Repository(r.spark, path=root)


_ST = ["dbid", "userid", "queryid", "calls"]
add("append_snapshot", lambda r: _appended(r).at("database", 1).select(*_DB), f"SELECT CAST(1 AS BIGINT) AS snapid, {_sql('database', _DB[1:])} FROM database WHERE snapid = {E}")
add(
    "append_snapshot_guarded",
    lambda r: _appended(r).at("statement", 1).select(*_ST),
    f"SELECT {_sql('statement', _ST)} FROM statement WHERE snapid = {E} AND dbid IN (SELECT dbid FROM database WHERE snapid = {E})",
)
add(
    "finish_snapshot",
    lambda r: _appended(r)
    .table("snapshot")
    .select("snapid", "instid", "comment", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("at"), (F.col("exec_time") > 0).alias("timed"), (F.col("snapshot_increase_size") > 0).alias("sized")),
    f"SELECT CAST(1 AS BIGINT) AS snapid, instid, 'again' AS comment, strftime(time, '%Y-%m-%d %H:%M:%S') AS at, true AS timed, true AS sized FROM snapshot WHERE snapid = {E}",
)

# --- files ----------------------------------------------------------------------


def _csvlog(r, read):
    """The log as CSV files in the server's format, one folder per server."""
    root, log = _root(r.spark), r.table("log")
    fields = []
    for f in logfile.raw_schema().names:
        c = F.col(f)
        if f == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS z")
        elif f == "session_start":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss z")
        fields.append(c.cast("string").alias(f))
    log.select("instid", *fields).write.partitionBy("instid").option("escape", '"').option("quoteAll", "true").csv(root)
    return read(r.spark, root)


_LOG = ["instid", "username", "database", "pid", "session_line_num", "elevel", "message", "user_query", "query_pos"]
add("csvlog_round_trip", lambda r: _csvlog(r, logfile.read_csvlog).select(*_LOG), f"SELECT {_sql('log', _LOG)} FROM log")
add("csvlog_pieces_round_trip", lambda r: _csvlog(r, logfile.read_large_csvlog).select(*_LOG), f"SELECT {_sql('log', _LOG)} FROM log")


def _bulk(r):
    root, names = _root(r.spark), schemas.column_names("database")
    rows = r.table("database").select(*[F.coalesce(F.col(n).cast("string"), F.lit("null")) for n in names])
    rows.write.option("sep", "\t").option("quote", "").csv(root)
    return logfile.bulk_load(r.spark, root, "database").select(*_DB)


add("bulk_load_round_trip", _bulk, f"SELECT {_sql('database', _DB)} FROM database")
