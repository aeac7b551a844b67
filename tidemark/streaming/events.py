"""Maintenance events parsed from log records.

Parsing is row-wise and works in batch and streaming.  Pairing (checkpoint start
with completion, cancel with its request) looks at the previous record of the same
key: batch jobs use a windowed lag cut by day, streams keep that one record as state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.clock import minus_seconds
from tidemark.operators.delta import with_previous_in_time
from tidemark.streaming.patterns import line_capture, lines_capture, matched, msg_capture, msg_match

# Server message formats.
CHECKPOINT_STARTING = "%s starting: %s"
CHECKPOINT_COMPLETE = (
    "%s complete: wrote %d buffers (%.1f%%); %d WAL file(s) added, %d removed, %d recycled; "
    "write=%ld.%03d s, sync=%ld.%03d s, total=%ld.%03d s; "
    "sync files=%d, longest=%ld.%03d s, average=%ld.%03d s; "
    "distance=%d kB, estimate=%d kB; lsn=%X/%X, redo lsn=%X/%X"
)
VACUUM = (
    '%s vacuum%s "%s.%s.%s": index scans: %d\n'
    "pages: %u removed, %u remain, %u scanned (%.2f%% of total)\n"
    "tuples: %lld removed, %lld remain, %lld are dead but not yet removable\n"
    "%s"
    "removable cutoff: %u, which was %d XIDs old when operation ended\n"
    "%s"
    "avg read rate: %.3f %s, avg write rate: %.3f %s\n"
    "buffer usage: %lld hits, %lld misses, %lld dirtied\n"
    "WAL usage: %lld records, %lld full page images, %llu bytes\n"
    "system usage: %s"
)
ANALYZE = (
    'automatic analyze of table "%s.%s.%s"\n'
    "%s"
    "avg read rate: %.3f %s, avg write rate: %.3f %s\n"
    "buffer usage: %lld hits, %lld misses, %lld dirtied\n"
    "system usage: %s"
)
RUSAGE = "CPU: user: %f s, system: %f s, elapsed: %f s"
TUPLES_MISSED = "tuples missed: %lld dead from %u pages not removed due to cleanup lock contention"
FROZEN_XID = "new relfrozenxid: %u, which is %d XIDs ahead of previous value"
MIN_MXID = "new relminmxid: %u, which is %d MXIDs ahead of previous value"
FROZEN_PAGES = "frozen: %u pages from table (%.2f%% of total) had %lld tuples frozen"
INDEX_SCAN = "index scan %s: %u pages from table (%.2f%% of total) %s %lld dead item %s"
INDEX_LINE = 'index "%s": pages: %u in total, %u newly deleted, %u currently deleted, %u reusable'
IO_TIMINGS = "I/O timings: read: %.3f ms, write: %.3f ms"
CANCEL_REQUEST = "sending cancel to blocking autovacuum PID %s"
CANCEL = "canceling autovacuum task"
CANCEL_CONTEXT = 'automatic %s of table "%s.%s.%s"'
INDEX_SCAN_KINDS = {"not needed": 1, "needed": 2, "bypassed": 3, "bypassed by failsafe": 4}
CANCEL_LIFETIME_SECONDS = 300

ORDER = ["timestamp", "session_line_num"]


def _item(c: str, i: int) -> Column:
    return F.get(F.col(c), F.lit(i))


def _column_of(c: str, i: int) -> Column:
    """One field of every captured line; no array without parsed options gives an empty array."""
    return F.coalesce(F.transform(c, lambda line: F.get(line, F.lit(i))), F.array().cast("array<string>"))


def _seconds(c: str, i: int) -> Column:
    return F.concat(_item(c, i), F.lit("."), _item(c, i + 1)).cast("float")


# --- checkpoints -------------------------------------------------------------


def checkpoint_records(log: DataFrame) -> DataFrame:
    """Start and completion records; ``kind`` is start, shutdown or complete."""
    message = F.col("message")
    begun = msg_capture(message, CHECKPOINT_STARTING)
    starting = F.element_at(begun, 1).isin("checkpoint", "restartpoint")
    done = msg_capture(message, CHECKPOINT_COMPLETE)
    relevant = log.where((F.col("elevel") == "LOG") & message.rlike("^(checkpoint|restartpoint) (starting|complete):"))
    flags = F.element_at(begun, 2)
    return (
        relevant.select("instid", *ORDER, done.alias("_done"), F.when(starting, flags).alias("flags"))
        .withColumn(
            "kind",
            F.when(F.col("_done").isNotNull(), "complete")
            .when(F.col("flags").contains("shutdown"), "shutdown")
            .when(F.col("flags").isNotNull(), "start"),
        )
        .where(F.col("kind").isNotNull())
    )


_CHECKPOINT_FIGURES = {"num_buffers": 1, "xlog_added": 3, "xlog_removed": 4, "xlog_recycled": 5}
_CHECKPOINT_TIMES = {"write_duration": 6, "sync_duration": 8, "total_duration": 10}


def _checkpoint_row(paired: DataFrame) -> DataFrame:
    return paired.where((F.col("kind") == "complete") & (F.col("prev_kind") == "start")).select(
        "instid",
        F.col("prev_timestamp").alias("start"),
        F.col("prev_flags").alias("flags"),
        *[_item("_done", i).cast("bigint").alias(c) for c, i in _CHECKPOINT_FIGURES.items()],
        *[_seconds("_done", i).alias(c) for c, i in _CHECKPOINT_TIMES.items()],
    )


def checkpoint_events(log: DataFrame) -> DataFrame:
    """``checkpoint`` rows: a completion directly preceded by a start that is no shutdown."""
    records = checkpoint_records(log)
    return _checkpoint_row(with_previous_in_time(records, ["instid"], ["kind", "timestamp", "flags"], ORDER))


# --- vacuum and analyze ------------------------------------------------------


def autovacuum_events(log: DataFrame) -> DataFrame:
    """``autovacuum`` rows; the start is the record's time minus the elapsed time."""
    message = F.col("message")
    candidates = log.where(
        (F.col("elevel") == "LOG") & message.startswith("automatic") & message.contains(" vacuum")
    ).select("instid", "timestamp", "message")
    parsed = matched(candidates, message, VACUUM, "v").drop("message")
    parsed = matched(parsed, _item("v", 27), RUSAGE, "u")
    parsed = parsed.select("*", _item("v", 13).alias("missed"), _item("v", 16).alias("extra"))
    kind = F.lit(None).cast("int")
    for text, number in INDEX_SCAN_KINDS.items():
        kind = F.when(_item("scan", 0) == text, number).otherwise(kind)
    parsed = parsed.select(
        "instid",
        "timestamp",
        "v",
        "u",
        line_capture(F.col("missed"), TUPLES_MISSED).alias("missed"),
        *[
            line_capture(F.col("extra"), pattern).alias(name)
            for name, pattern in (
                ("xid", FROZEN_XID), ("mxid", MIN_MXID), ("frozen", FROZEN_PAGES), ("scan", INDEX_SCAN), ("io", IO_TIMINGS)
            )
        ],
        lines_capture(F.col("extra"), INDEX_LINE).alias("indexes"),
    )
    # a record with an unknown kind of index scan is dropped (no pushed filter, as in matched())
    usable = F.when(F.col("scan").isNull() | kind.isNotNull(), F.lit(True))
    parsed = parsed.select("*", F.explode(F.array_compact(F.array(usable))).alias("_usable"))
    elapsed = _item("u", 2)
    v = lambda i, kind_: _item("v", i).cast(kind_)
    big = lambda c: c.cast("bigint")
    columns = {
        "instid": F.col("instid"),
        "start": minus_seconds(F.col("timestamp"), elapsed.cast("double")),
        "database": _item("v", 2),
        "schema": _item("v", 3),
        "table": _item("v", 4),
        "index_scans": v(5, "int"),
        "page_removed": v(6, "bigint"),
        "page_remain": v(7, "bigint"),
        "tbl_scan_pages": v(8, "bigint"),
        "tbl_scan_pages_ratio": v(9, "double"),
        "tup_removed": v(10, "bigint"),
        "tup_remain": v(11, "bigint"),
        "tup_dead": v(12, "bigint"),
        "removable_cutoff": v(14, "decimal(20,0)"),
        "read_rate": v(17, "double"),
        "write_rate": v(19, "double"),
        "page_hit": v(21, "bigint"),
        "page_miss": v(22, "bigint"),
        "page_dirty": v(23, "bigint"),
        "wal_records": v(24, "bigint"),
        "wal_page_images": v(25, "bigint"),
        "wal_bytes": v(26, "bigint"),
        "duration": elapsed.cast("float"),
        "tup_miss_dead": big(_item("missed", 0)),
        "tup_miss_dead_pages": big(_item("missed", 1)),
        "new_relfrozenxid": _item("xid", 0).cast("decimal(20,0)"),
        "new_relminmxid": _item("mxid", 0).cast("decimal(20,0)"),
        "frozen_pages": big(_item("frozen", 0)),
        "frozen_pages_ratio": _item("frozen", 1).cast("double"),
        "frozen_tuples": big(_item("frozen", 2)),
        "index_scan_ptn": kind,
        "dead_lp_pages": big(_item("scan", 1)),
        "dead_lp_pages_ratio": _item("scan", 2).cast("double"),
        "dead_lp": big(_item("scan", 4)),
        "index_names": _column_of("indexes", 0),
        "index_pages_total": _column_of("indexes", 1).cast("array<bigint>"),
        "index_pages_new_del": _column_of("indexes", 2).cast("array<bigint>"),
        "index_pages_current_del": _column_of("indexes", 3).cast("array<bigint>"),
        "index_pages_reusable": _column_of("indexes", 4).cast("array<bigint>"),
        "io_timings_read": _item("io", 0).cast("double"),
        "io_timings_write": _item("io", 1).cast("double"),
    }
    return parsed.select(*[columns[c].alias(c) for c in schemas.struct("autovacuum").names])


def autoanalyze_events(log: DataFrame) -> DataFrame:
    message = F.col("message")
    candidates = log.where((F.col("elevel") == "LOG") & message.startswith("automatic analyze")).select(
        "instid", "timestamp", "message"
    )
    parsed = matched(candidates, message, ANALYZE, "a").drop("message")
    parsed = matched(parsed, _item("a", 11), RUSAGE, "u")
    parsed = parsed.select("*", line_capture(_item("a", 3), IO_TIMINGS).alias("io"))
    elapsed = _item("u", 2)
    return parsed.select(
        "instid",
        minus_seconds(F.col("timestamp"), elapsed.cast("double")).alias("start"),
        _item("a", 0).alias("database"),
        _item("a", 1).alias("schema"),
        _item("a", 2).alias("table"),
        *[_item("a", i).cast("bigint").alias(f"page_{k}") for i, k in ((8, "hit"), (9, "miss"), (10, "dirty"))],
        _item("a", 4).cast("double").alias("read_rate"),
        _item("a", 6).cast("double").alias("write_rate"),
        elapsed.cast("float").alias("duration"),
        *[_item("io", i).cast("double").alias(f"io_timings_{k}") for i, k in ((0, "read"), (1, "write"))],
    )


# --- cancels -----------------------------------------------------------------


def cancel_records(log: DataFrame) -> DataFrame:
    """Cancel requests (``kind`` request, keyed by the worker's pid) and cancels."""
    request = (
        (F.col("elevel") == "LOG")
        & F.col("message").rlike(r"^\w+: autovacuum cancel request$")
        & msg_match(F.col("hint"), CANCEL_REQUEST)
    )
    cancel = (F.col("elevel") == "ERROR") & (F.col("message") == CANCEL)
    worker = F.element_at(msg_capture(F.col("hint"), CANCEL_REQUEST), 1).try_cast("int")
    target = line_capture(F.col("context"), CANCEL_CONTEXT)
    return (
        log.where(F.coalesce(request, F.lit(False)) | F.coalesce(cancel, F.lit(False)))
        .select(
            "instid",
            F.when(cancel, F.col("pid")).otherwise(worker).alias("worker"),
            *ORDER,
            F.when(cancel, "cancel").otherwise("request").alias("kind"),
            F.col("user_query").alias("query"),
            target.alias("_target"),
        )
        .select("*", *[_item("_target", i).alias(name) for i, name in enumerate(("work", "database", "schema", "table"))])
        .drop("_target")
        .where(F.col("worker").isNotNull() & ((F.col("kind") == "request") | F.col("work").isNotNull()))
    )


def _cancel_row(paired: DataFrame) -> DataFrame:
    age = F.unix_micros("timestamp") - F.unix_micros("prev_timestamp")
    known = (F.col("prev_kind") == "request") & (age <= CANCEL_LIFETIME_SECONDS * 1_000_000)
    return paired.where(F.col("kind") == "cancel").select(
        "work", "instid", "timestamp", "database", "schema", "table", F.when(known, F.col("prev_query")).alias("query")
    )


def cancel_events(log: DataFrame) -> DataFrame:
    """Cancels with the query of the request that directly precedes them for that worker.

    A request serves one cancel and a newer request replaces it, so only the
    worker's previous record can be the match.
    """
    records = cancel_records(log)
    return _cancel_row(with_previous_in_time(records, ["instid", "worker"], ["kind", "timestamp", "query"], ORDER))


def autovacuum_cancels(cancels: DataFrame) -> DataFrame:
    return cancels.where(F.col("work") == "vacuum").drop("work")


def autoanalyze_cancels(cancels: DataFrame) -> DataFrame:
    return cancels.where(F.col("work") == "analyze").drop("work")
