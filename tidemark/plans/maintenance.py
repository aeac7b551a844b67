"""Event reports: checkpoints, vacuum and analyze work, long transactions, locks, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clock import minute_label, to_second
from tidemark.functions.numeric import mean, mean_real, round_real
from tidemark.operators.delta import with_previous
from tidemark.operators.events import interval_join
from tidemark.operators.ranking import asc, desc, top
from tidemark.plans.common import in_scope, scope_length
from tidemark.plans.relations import view_tables
from tidemark.repository import Repository

TABLE = ["database", "schema", "table"]
TOP_LONG_TRANSACTIONS = 10
TOP_LOCKS = 20


def _named() -> list[Column]:
    return [F.col("database").alias("datname"), F.col("schema").alias("nspname"), F.col("table").alias("relname")]


def _or_zero(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.lit(0)).cast(kind)


def checkpoint_activity(repo: Repository, begin: int, end: int) -> DataFrame:
    def flagged(word: str) -> Column:
        return F.count_if(F.contains(F.col("flags"), F.lit(word)))

    return repo.events("checkpoint", begin, end).agg(
        F.count(F.lit(1)).alias("ckpt_total"),
        flagged("time").alias("ckpt_time"),
        flagged("wal").alias("ckpt_wal"),
        mean(F.col("num_buffers")).alias("avg_write_buff"),
        F.max("num_buffers").cast("decimal(30,3)").alias("max_write_buff"),
        mean_real(F.col("total_duration")).alias("avg_duration"),
        round_real(F.max("total_duration"), "decimal(30,3)").alias("max_duration"),
    )


# index scan kinds recorded by the log parser
SCANNED, SKIPPED_BY_FAILSAFE = 2, 4


def autovacuum_activity(repo: Repository, begin: int, end: int) -> DataFrame:
    """Vacuum work and cancels per table.

    Runs and cancels are stacked and grouped once; conditional aggregates take
    the place of separate groups joined back together.
    """
    runs = repo.events("autovacuum", begin, end).withColumn("_cancel", F.lit(0))
    cancels = repo.events("autovacuum_cancel", begin, end).select(*TABLE, F.lit(1).alias("_cancel"))
    both = runs.unionByName(cancels, allowMissingColumns=True)
    tenth = "decimal(30,1)"
    scanned = F.col("index_scan_ptn") == SCANNED
    skipped = F.col("index_scan_ptn") == SKIPPED_BY_FAILSAFE

    def whole(c: str, only: Column | None = None) -> Column:
        value = F.col(c) if only is None else F.when(only, F.col(c))
        return _or_zero(mean(value, tenth), tenth)

    def real(c: str, only: Column | None = None) -> Column:
        value = F.col(c) if only is None else F.when(only, F.col(c))
        return _or_zero(mean_real(value, tenth), tenth)

    return (
        both.groupBy(*TABLE)
        .agg(
            F.count_if(F.col("_cancel") == 0).alias("count"),
            F.count_if(scanned).alias("index_scanned"),
            F.count_if(skipped).alias("index_skipped"),
            whole("tup_removed").alias("avg_tup_removed"),
            whole("tup_remain").alias("avg_tup_remain"),
            whole("tup_dead").alias("avg_tup_dead"),
            whole("tup_miss_dead").alias("avg_tup_miss_dead"),
            whole("tup_miss_dead_pages").alias("avg_tup_miss_dead_pages"),
            whole("tbl_scan_pages").alias("tbl_scan_pages"),
            real("tbl_scan_pages_ratio").alias("tbl_scan_pages_ratio"),
            whole("dead_lp_pages", scanned).alias("dead_lp_pages"),
            real("dead_lp_pages_ratio", scanned).alias("dead_lp_pages_ratio"),
            whole("dead_lp", scanned).alias("removed_lp"),
            whole("dead_lp", skipped).alias("dead_lp"),
            _or_zero(F.sum("index_scans"), tenth).alias("sum_index_scans"),
            real("duration").alias("avg_duration"),
            _or_zero(round_real(F.max("duration"), tenth), tenth).alias("max_duration"),
            F.sum("_cancel").alias("cancel"),
            F.max("removable_cutoff").cast("bigint").alias("max_cutoff_xid"),
            F.max("new_relfrozenxid").cast("bigint").alias("max_frozen_xid"),
            F.max("new_relminmxid").cast("bigint").alias("max_relmin_mxid"),
        )
        .orderBy(desc("avg_tup_removed"), *[asc(c) for c in TABLE])
        .withColumnsRenamed({"database": "datname", "schema": "nspname", "table": "relname"})
    )


def _buffer_activity(events: DataFrame) -> DataFrame:
    """Mean page and rate figures per table; absent I/O timings count as 0."""
    return (
        events.groupBy(*TABLE)
        .agg(
            *[mean(F.col(f"page_{k}")).alias(f"avg_page_{k}") for k in ("hit", "miss", "dirty")],
            *[mean_real(F.col(f"{k}_rate")).alias(f"avg_{k}_rate") for k in ("read", "write")],
            *[
                mean_real(F.coalesce(F.col(f"io_timings_{k}"), F.lit(0.0))).alias(f"avg_{k}_duration")
                for k in ("read", "write")
            ],
        )
        .orderBy(desc("avg_page_hit"), *[asc(c) for c in TABLE])
        .withColumnsRenamed({"database": "datname", "schema": "nspname", "table": "relname"})
    )


def autovacuum_activity2(repo: Repository, begin: int, end: int) -> DataFrame:
    return _buffer_activity(repo.events("autovacuum", begin, end))


def autoanalyze_activity2(repo: Repository, begin: int, end: int) -> DataFrame:
    return _buffer_activity(repo.events("autoanalyze", begin, end))


def autovacuum_wal_activity(repo: Repository, begin: int, end: int) -> DataFrame:
    kind = "decimal(30,3)"
    return (
        repo.events("autovacuum", begin, end)
        .groupBy(*TABLE)
        .agg(
            F.count(F.lit(1)).alias("count"),
            _or_zero(mean(F.col("wal_records")), kind).alias("wal_records"),
            _or_zero(mean(F.col("wal_page_images")), kind).alias("wal_fpis"),
            _or_zero(mean(F.col("wal_bytes")), kind).alias("wal_bytes"),
        )
        .orderBy(desc("wal_bytes"), *[asc(c) for c in TABLE])
        .withColumnsRenamed({"database": "datname", "schema": "nspname", "table": "relname"})
    )


def autovacuum_wal_tendency(repo: Repository, begin: int, end: int) -> DataFrame:
    """WAL written by vacuum between consecutive snapshots (both ends count)."""
    intervals = with_previous(
        repo.timeline(begin, end), ["instid"], ["time"], scope_length=scope_length(begin, end)
    )
    runs = repo.events("autovacuum", begin, end).select("instid", "start", "wal_page_images", "wal_bytes")
    return (
        interval_join(runs, intervals, "start", "prev_time", "time", ["instid"])
        .groupBy("snapid", "time")
        .agg(F.sum("wal_page_images").alias("wal_fpi"), F.sum("wal_bytes").alias("wal_bytes"))
        .orderBy("snapid")
        .select("snapid", minute_label(F.col("time")).alias("timestamp"), "wal_fpi", "wal_bytes")
    )


# parallel array -> report column
_INDEX_PAGES = {
    "index_pages_total": "page_total",
    "index_pages_new_del": "page_new_del",
    "index_pages_current_del": "page_cur_del",
    "index_pages_reusable": "page_reuse",
}


def autovacuum_index_activity(repo: Repository, begin: int, end: int) -> DataFrame:
    runs = repo.events("autovacuum", begin, end)
    per_index = runs.select(*TABLE, F.explode(F.arrays_zip("index_names", *_INDEX_PAGES)).alias("i"))
    return (
        per_index.groupBy(*TABLE, F.col("i.index_names").alias("index_name"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            *[mean(F.col(f"i.{c}")).alias(out) for c, out in _INDEX_PAGES.items()],
        )
        .orderBy(
            desc("page_total"), desc("page_new_del"), desc("page_reuse"), *[asc(c) for c in [*TABLE, "index_name"]]
        )
        .withColumnsRenamed({"database": "datname", "schema": "nspname", "table": "relname"})
    )


def autoanalyze_stats(repo: Repository, begin: int, end: int) -> DataFrame:
    runs = repo.events("autoanalyze", begin, end).select(
        *TABLE, "start", F.col("duration").cast("double").alias("duration"), F.lit(0).alias("_cancel")
    )
    cancels = repo.events("autoanalyze_cancel", begin, end).select(*TABLE, F.lit(1).alias("_cancel"))
    kind = "decimal(30,3)"
    work = (
        runs.unionByName(cancels, allowMissingColumns=True)
        .groupBy(*TABLE)
        .agg(
            _or_zero(round_real(F.sum("duration"), kind), kind).alias("total_duration"),
            _or_zero(mean_real(F.col("duration")), kind).alias("avg_duration"),
            _or_zero(round_real(F.max("duration"), kind), kind).alias("max_duration"),
            F.count_if(F.col("_cancel") == 0).alias("count"),
            to_second(F.max("start")).alias("last_analyze"),
            F.sum("_cancel").alias("cancels"),
        )
    )
    # The scope's snapshots are broadcast first, so only this instance's rows meet the names.
    reader = lambda name: repo.scoped(name, begin, end)
    modified = (
        view_tables(repo, reader).groupBy(*TABLE).agg(F.max("n_mod_since_analyze").alias("mod_rows_max"))
    )
    return (
        work.join(modified, TABLE, "left")
        .orderBy(desc("total_duration"), *[asc(c) for c in TABLE])
        .select(
            *_named(), "total_duration", "avg_duration", "max_duration", "count", "last_analyze", "cancels",
            "mod_rows_max",
        )
    )


def long_transactions(repo: Repository, begin: int, end: int, limit: int | None = None) -> DataFrame:
    sampled = in_scope(repo, "xact", begin, end).where(F.col("pid") != 0)
    longest = sampled.groupBy("pid", "client", "start").agg(
        round_real(F.max("duration"), "decimal(30,3)").alias("duration"), F.max_by("query", "snapid").alias("query")
    )
    return top(longest, [desc("duration"), asc("pid"), asc("start")], limit).select(
        "pid", "client", to_second(F.col("start")).alias("start"), "duration", "query"
    )


def lock_activity(repo: Repository, begin: int, end: int, limit: int | None = None) -> DataFrame:
    """Latest sample of every blocking edge in ``(begin, end]``."""
    edge = ["dbid", "nspname", "relname", "blockee_pid", "blocker_pid", "blocker_gid", "blockee_query"]
    locks = in_scope(repo, "lock", begin, end).where(F.col("snapid") > begin)
    latest = locks.groupBy(*edge).agg(F.max("snapid").alias("snapid"))

    def keyed(df: DataFrame) -> DataFrame:
        return df.select(
            "*",
            F.coalesce("dbid", F.lit(0)).alias("_db"),
            *[F.coalesce(c, F.lit("")).alias(f"_{c}") for c in ("nspname", "relname", "blocker_gid")],
        )

    match = ["snapid", "_db", "_nspname", "_relname", "_blocker_gid", "blockee_pid", "blocker_pid", "blockee_query"]
    sample = keyed(locks).select(*match, "duration", "blocker_query")
    names = view_tables(repo, lambda name: repo.scoped(name, begin, end)).select(
        "snapid", "dbid", F.col("tbl").alias("_relid"), "database", "schema", "table"
    )
    edges = (
        keyed(latest)
        .join(sample, match, "left")
        .withColumn("_relid", F.col("relname").try_cast("bigint"))
        .join(names, ["snapid", "dbid", "_relid"], "left")
    )
    ranked = top(edges, [desc("duration"), asc("blockee_pid"), asc("blocker_pid"), asc("relname")], limit)
    unknown = F.concat(F.lit("OID:["), F.col("relname"), F.lit("]"))
    return ranked.select(
        F.col("database").alias("datname"),
        F.col("schema").alias("nspname"),
        F.coalesce(F.col("table"), unknown).alias("relname"),
        "duration",
        "blockee_pid",
        "blocker_pid",
        "blocker_gid",
        "blockee_query",
        "blocker_query",
    )


def alert_list(repo: Repository, begin: int, end: int) -> DataFrame:
    return (
        in_scope(repo, "alert_message", begin, end)
        .orderBy("time", "message")
        .select(to_second(F.col("time")).alias("timestamp"), "message")
    )


def profiles(repo: Repository, begin: int, end: int) -> DataFrame:
    return (
        in_scope(repo, "profile", begin, end)
        .groupBy("processing")
        .agg(F.sum("execute").alias("executes"))
        .orderBy(asc("executes"), "processing")
    )
