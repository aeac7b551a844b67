"""Catalog and statistics rows of monitored servers shaped into snapshot facts.

Inputs are landed tables named after the server's own views and functions.
``scope`` names extra key columns (for example ``instid`` and ``dbid``) when one
job shapes the rows of many servers; all joins, groups and top-n limits then work
per scope.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators.ranking import desc

TOP_STATEMENTS = 30  # fixed value: statements, plans and usage rows kept per snapshot
Scope = Sequence[str]


def _not_listed(c: Column, names: Sequence[str]) -> Column:
    """``name <> ALL (list)``: NULL names never pass unless the list is empty."""
    return ~c.isin(*names) if names else F.lit(True)


def _project(df: DataFrame, table: str, scope: Scope, given: dict[str, Column] | None = None) -> DataFrame:
    """Fact columns in schema order (without snapid and date) from same-named input columns."""
    given = given or {}
    names = [n for n in schemas.struct(table).names if n not in ("snapid", "date") and n not in scope]
    return df.select(*scope, *[(given[n] if n in given else F.col(n)).alias(n) for n in names])


# --- databases, settings, roles ----------------------------------------------


def ingest_database(databases: DataFrame, excluded: Sequence[str] = (), scope: Scope = ()) -> DataFrame:
    """``pg_database`` with its statistics; reads are fetches that were no hits."""
    open_ones = databases.where(F.col("datallowconn") & _not_listed(F.col("datname"), excluded))
    return _project(
        open_ones,
        "database",
        scope,
        {
            "name": F.col("datname"),
            "age": F.when(F.col("in_recovery"), F.lit(0)).otherwise(F.col("age")),
            "blks_read": F.col("blks_fetched") - F.col("blks_hit"),
        },
    )


def ingest_setting(settings: DataFrame, scope: Scope = ()) -> DataFrame:
    """Settings that differ from their boot value and were not set by a client."""
    kept = settings.where(
        ~F.col("source").isin("client", "default", "session") & (F.col("setting") != F.col("boot_val"))
    )
    return _project(kept, "setting", scope)


def ingest_role(roles: DataFrame, scope: Scope = ()) -> DataFrame:
    return _project(roles, "role", scope, {"userid": F.col("oid"), "name": F.col("rolname")})


def _leaders(df: DataFrame, by: str, n: int, scope: Scope, ties: Sequence[str]) -> DataFrame:
    """First ``n`` rows by ``by`` (per scope a group limit, else a top-k plan)."""
    order = [desc(by), *[F.col(t) for t in ties]]
    if not scope:
        return df.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def _of_known_users(df: DataFrame, roles: DataFrame, excluded: Sequence[str], scope: Scope) -> DataFrame:
    """Rows whose role exists and is not excluded."""
    named = roles.select(*scope, F.col("oid").alias("userid"), "rolname")
    if not excluded:
        return df.join(named, [*scope, "userid"], "left").drop("rolname")
    return df.join(named.where(_not_listed(F.col("rolname"), excluded)), [*scope, "userid"], "left_semi")


def ingest_statement(
    statements: DataFrame, roles: DataFrame, excluded: Sequence[str] = (), n: int = TOP_STATEMENTS, scope: Scope = ()
) -> DataFrame:
    """Statements with the most execution time; plan and execution times in seconds."""
    kept = _of_known_users(statements, roles, excluded, scope)
    top = _leaders(kept, "total_exec_time", n, scope, ["dbid", "userid", "queryid"])
    seconds = {c: F.col(c) / 1000 for c in ("total_plan_time", "total_exec_time")}
    return _project(top, "statement", scope, seconds)


def ingest_plan(
    plans: DataFrame, roles: DataFrame, excluded: Sequence[str] = (), n: int = TOP_STATEMENTS, scope: Scope = ()
) -> DataFrame:
    kept = _of_known_users(plans, roles, excluded, scope)
    top = _leaders(kept, "total_time", n, scope, ["dbid", "userid", "queryid", "planid"])
    return _project(top, "plan", scope, {"total_time": F.col("total_time") / 1000})


def ingest_rusage(
    usage: DataFrame, roles: DataFrame, excluded: Sequence[str] = (), n: int = TOP_STATEMENTS, scope: Scope = ()
) -> DataFrame:
    kept = _of_known_users(usage, roles, excluded, scope)
    return _project(_leaders(kept, "exec_user_time", n, scope, ["dbid", "userid", "queryid"]), "rusage", scope)


# --- locks -------------------------------------------------------------------

# Shown when the blocker's own queries are not known.
DETACHED = "(xact is detached from session)"
NOT_LOADED = "(library might not have been loaded)"


def ingest_lock_edges(
    locks: DataFrame,
    activity: DataFrame,
    relations: DataFrame,
    namespaces: DataFrame,
    prepared: DataFrame,
    last_queries: DataFrame,
    now: Column,
    threshold_seconds: float,
    scope: Scope = (),
) -> DataFrame:
    """Blocking edges of lock waits older than the threshold.

    ``locks`` has one row per ungranted lock with the ids that block it.
    """
    waited = F.unix_micros(now) - F.unix_micros(F.col("waitstart"))
    edges = (
        locks.where(~F.col("granted") & (waited > int(threshold_seconds * 1_000_000)))
        .select(
            *scope, F.col("pid").alias("blockee_pid"), F.explode("blocking_pids").alias("blocker_pid"),
            "transactionid", "relation", "waitstart",
        )
        .distinct()
    )
    detached = prepared.select(*scope, F.col("transaction").alias("transactionid"), F.col("gid").alias("blocker_gid"))
    session = activity.select(
        *scope, F.col("pid").alias("blockee_pid"), F.col("datid").alias("dbid"),
        F.col("application_name").alias("blocker_appname"), F.col("client_addr").alias("blocker_addr"),
        F.col("client_hostname").alias("blocker_hostname"), F.col("client_port").alias("blocker_port"),
        "wait_event_type", "wait_event", F.col("query").alias("blockee_query"),
    )
    blocker = last_queries.select(*scope, F.col("pid").alias("blocker_pid"), "queries")
    owner = relations.select(*scope, F.col("oid").alias("relation"), F.col("relnamespace").alias("_nsp"))
    space = namespaces.select(*scope, F.col("oid").alias("_nsp"), "nspname")
    joined = (
        edges.join(detached, [*scope, "transactionid"], "left")
        .join(session, [*scope, "blockee_pid"], "left")
        .join(blocker, [*scope, "blocker_pid"], "left")
        .join(owner, [*scope, "relation"], "left")
        .join(space, [*scope, "_nsp"], "left")
    )
    query = (
        F.when(F.col("blocker_gid").isNotNull(), F.lit(DETACHED))
        .when(F.col("queries").isNull(), F.lit(NOT_LOADED))
        .otherwise(F.col("queries"))
    )
    whole = F.round((F.unix_micros(now) - F.unix_micros("waitstart")) / F.lit(1_000_000)).cast("bigint")
    return _project(
        joined,
        "lock",
        scope,
        {"relname": F.col("relation").cast("string"), "duration": whole * 1_000_000, "blocker_query": query},
    )


# --- relations ---------------------------------------------------------------

KINDS = ("r", "t")


def _visible(df: DataFrame, namespaces: DataFrame, excluded: Sequence[str], scope: Scope) -> DataFrame:
    """Tables and toast tables outside the excluded schemas."""
    shown = namespaces.where(_not_listed(F.col("nspname"), excluded)).select(*scope, F.col("oid").alias("relnamespace"))
    return df.where(F.col("relkind").isin(*KINDS)).join(shown, [*scope, "relnamespace"], "left_semi")


def _index_sums(indexes: DataFrame, scope: Scope) -> DataFrame:
    """Statistics of the valid indexes per table; tables whose indexes are all invalid are marked."""
    valid = F.col("indisvalid")
    miss = F.col("blks_fetched") - F.col("blks_hit")
    return indexes.groupBy(*scope, "indrelid").agg(
        F.max(valid.cast("int")).alias("any_valid"),
        F.max(F.when(valid, F.col("indexrelid"))).alias("indexrelid"),
        F.sum(F.when(valid, F.col("numscans"))).alias("scans"),
        F.sum(F.when(valid, F.col("tuples_fetched"))).alias("fetched"),
        F.sum(F.when(valid, miss)).alias("read"),
        F.sum(F.when(valid, F.col("blks_hit"))).alias("hit"),
    )


def ingest_relation_rollup(
    relations: DataFrame,
    indexes: DataFrame,
    namespaces: DataFrame,
    excluded: Sequence[str] = (),
    scope: Scope = (),
) -> DataFrame:
    """Tables with the summed counters of their indexes, toast table and toast index.

    Index statistics are reduced per table before the joins, so no join multiplies rows.
    """
    sums = _index_sums(indexes, scope)
    own = sums.select(
        *scope, F.col("indrelid").alias("oid"), F.col("any_valid").alias("_i"), F.col("scans").alias("idx_scan"),
        F.col("fetched").alias("_fetched"), F.col("read").alias("idx_blks_read"), F.col("hit").alias("idx_blks_hit"),
    )
    toast = relations.select(
        *scope, F.col("oid").alias("reltoastrelid"), (F.col("blks_fetched") - F.col("blks_hit")).alias("toast_blks_read"),
        F.col("blks_hit").alias("toast_blks_hit"),
    )
    toast_index = sums.select(
        *scope, F.col("indrelid").alias("reltoastrelid"), F.col("any_valid").alias("_x"), F.col("indexrelid").alias("toastidxid"),
        F.col("read").alias("tidx_blks_read"), F.col("hit").alias("tidx_blks_hit"),
    )
    joined = (
        _visible(relations, namespaces, excluded, scope)
        .join(own, [*scope, "oid"], "left")
        .join(toast, [*scope, "reltoastrelid"], "left")
        .join(toast_index, [*scope, "reltoastrelid"], "left")
        .where("coalesce(_i, 1) = 1 AND coalesce(_x, 1) = 1")
    )
    return _project(
        joined,
        "table",
        scope,
        {
            "tbl": F.col("oid"),
            "nsp": F.col("relnamespace"),
            "tbs": F.col("reltablespace"),
            "name": F.col("relname"),
            "toastrelid": F.col("reltoastrelid"),
            "seq_scan": F.col("numscans"),
            "seq_tup_read": F.col("tuples_returned"),
            "idx_tup_fetch": F.col("_fetched") + F.col("tuples_fetched"),
            "heap_blks_read": F.col("blks_fetched") - F.col("blks_hit"),
            "heap_blks_hit": F.col("blks_hit"),
            **{"dbid": F.col("dbid") if "dbid" in relations.columns else F.lit(None).cast("bigint")},
        },
    )


CORRELATION_KIND = 3  # statistics slot kind that holds the correlation


def ingest_column_stats(
    attributes: DataFrame,
    statistics: DataFrame,
    relations: DataFrame,
    namespaces: DataFrame,
    excluded: Sequence[str] = (),
    scope: Scope = (),
) -> DataFrame:
    """Columns with width, distinct count and correlation (first slot of the right kind)."""
    correlation = F.lit(None).cast("float")
    for slot in (4, 3, 2, 1):
        correlation = F.when(
            F.col(f"stakind{slot}") == CORRELATION_KIND, F.get(F.col(f"stanumbers{slot}"), F.lit(0))
        ).otherwise(correlation)
    slots = (
        statistics.where(~F.col("stainherit"))
        .withColumn("correlation", correlation)
        .select(
            *scope, F.col("starelid").alias("attrelid"), F.col("staattnum").alias("attnum"),
            F.col("stawidth").alias("avg_width"), F.col("stadistinct").alias("n_distinct"), "correlation",
        )
    )
    shown = _visible(relations, namespaces, excluded, scope).select(*scope, F.col("oid").alias("attrelid"))
    joined = (
        attributes.where(F.col("attnum") > 0)
        .join(shown, [*scope, "attrelid"], "left_semi")
        .join(slots, [*scope, "attrelid", "attnum"], "left")
    )
    return _project(
        joined,
        "column",
        scope,
        {
            "tbl": F.col("attrelid"),
            "name": F.col("attname"),
            "stattarget": F.col("attstattarget"),
            "storage": F.col("attstorage"),
            "isnotnull": F.col("attnotnull"),
            "isdropped": F.col("attisdropped"),
            "dbid": F.col("dbid") if "dbid" in attributes.columns else F.lit(None).cast("bigint"),
        },
    )


def ingest_index(
    indexes: DataFrame,
    relations: DataFrame,
    namespaces: DataFrame,
    excluded: Sequence[str] = (),
    scope: Scope = (),
) -> DataFrame:
    """Indexes of visible tables; reads are fetches that were no hits."""
    shown = _visible(relations, namespaces, excluded, scope).select(*scope, F.col("oid").alias("indrelid"))
    entry = relations.select(
        *scope, F.col("oid").alias("indexrelid"), "reltablespace", "relname", "relam", "relpages", "reltuples", "reloptions",
        "size",
    )
    joined = indexes.join(shown, [*scope, "indrelid"], "left_semi").join(entry, [*scope, "indexrelid"])
    flags = {f"is{k}": F.col(f"indis{k}") for k in ("unique", "primary", "clustered", "valid")}
    return _project(
        joined,
        "index",
        scope,
        {
            "idx": F.col("indexrelid"),
            "tbl": F.col("indrelid"),
            "tbs": F.col("reltablespace"),
            "name": F.col("relname"),
            "idx_scan": F.col("numscans"),
            "idx_tup_read": F.col("tuples_returned"),
            "idx_tup_fetch": F.col("tuples_fetched"),
            "idx_blks_read": F.col("blks_fetched") - F.col("blks_hit"),
            "idx_blks_hit": F.col("blks_hit"),
            "dbid": F.col("dbid") if "dbid" in indexes.columns else F.lit(None).cast("bigint"),
            **flags,
        },
    )


def ingest_schema(namespaces: DataFrame, excluded: Sequence[str] = (), scope: Scope = ()) -> DataFrame:
    shown = namespaces.where(_not_listed(F.col("nspname"), excluded))
    return shown.select(*scope, F.col("oid").alias("nsp"), F.col("nspname").alias("name"))


def ingest_inherits(
    inherits: DataFrame,
    relations: DataFrame,
    namespaces: DataFrame,
    excluded: Sequence[str] = (),
    scope: Scope = (),
) -> DataFrame:
    shown = namespaces.where(_not_listed(F.col("nspname"), excluded)).select(*scope, F.col("oid").alias("relnamespace"))
    child = relations.join(shown, [*scope, "relnamespace"], "left_semi").select(*scope, F.col("oid").alias("inhrelid"))
    return inherits.join(child, [*scope, "inhrelid"], "left_semi").select(*scope, "inhrelid", "inhparent", "inhseqno")


def ingest_function(
    functions: DataFrame, namespaces: DataFrame, excluded: Sequence[str] = (), scope: Scope = ()
) -> DataFrame:
    space = namespaces.where(_not_listed(F.col("nspname"), excluded)).select(
        *scope, F.col("nspname").alias("schemaname"), F.col("oid").alias("nsp")
    )
    return functions.join(space, [*scope, "schemaname"]).select(
        *scope, "funcid", "nsp", "funcname", "argtypes", "calls", "total_time", "self_time"
    )


# --- replication and plain counters ------------------------------------------

_SEGMENT = 4294967296


def _lsn_text(lsn: Column, file: Column, in_recovery: Column) -> Column:
    """WAL address with the file that holds it in brackets."""
    return F.concat(lsn, F.lit(" ("), F.when(in_recovery, F.lit("N/A")).otherwise(file), F.lit(")"))


def wal_file(lsn: Column, timeline: Column, segment_bytes: int = 16 * 1024 * 1024) -> Column:
    """Name of the WAL file that holds the byte before ``lsn``."""
    from tidemark.functions.text import lsn_position

    number = F.floor((lsn_position(lsn) - 1) / F.lit(segment_bytes)).cast("bigint")
    per_id = _SEGMENT // segment_bytes
    return F.format_string("%08X%08X%08X", timeline, F.floor(number / F.lit(per_id)).cast("bigint"), number % per_id)


def ingest_replication(senders: DataFrame, scope: Scope = ()) -> DataFrame:
    """Senders with WAL addresses as text and absent lags as zero."""
    recovering = F.col("in_recovery")
    places = {
        f"{k}_location": _lsn_text(F.col(f"{k}_lsn"), F.col(f"{k}_file"), recovering)
        for k in ("current", "sent", "write", "flush", "replay")
    }
    lags = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("write_lag", "flush_lag", "replay_lag")}
    return _project(senders, "replication", scope, {"procpid": F.col("pid"), **places, **lags})


PLAIN_COUNTERS = (
    "bgwriter", "replication_slots", "stat_replication_slots", "stat_io", "stat_wal", "archive", "wait_sampling",
)
SAMPLED = ("activity", "xact", "tablespace", "cpu", "device", "loadavg", "memory", "profile")


def ingest_plain(view: DataFrame, table: str, scope: Scope = ()) -> DataFrame:
    """Counter views and landed samples whose columns are the fact's columns."""
    if table not in PLAIN_COUNTERS + SAMPLED:
        raise ValueError(f"{table} is not a plain projection")
    return _project(view, table, scope)


def ingest_xlog(position: DataFrame, scope: Scope = ()) -> DataFrame:
    """Current WAL position of servers that are not in recovery."""
    return _project(position.where(~F.col("in_recovery")), "xlog", scope)


def ingest_ht_info(
    wait_sampling: DataFrame, rusage: DataFrame, statements: DataFrame | None = None, scope: Scope = ()
) -> DataFrame:
    """One row from up to three one-row sources; the statement source may be absent."""

    def named(df: DataFrame, source: str) -> DataFrame:
        return df.select(*scope, F.col("dealloc").alias(f"{source}_dealloc"), F.col("stats_reset").alias(f"{source}_reset"))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        if scope:
            return left.join(right, list(scope))
        only = right.agg(F.max(F.struct(*right.columns))).scalar()
        return left.withColumn("_right", only).where("_right IS NOT NULL").select("*", "_right.*").drop("_right")

    both = beside(named(wait_sampling, "wait_sampling"), named(rusage, "rusage"))
    if statements is None:
        both = both.withColumns(
            {
                "statements_dealloc": F.lit(None).cast("bigint"),
                "statements_reset": F.lit(None).cast("timestamp"),
            }
        )
    else:
        both = beside(both, named(statements, "statements"))
    return _project(both, "ht_info", scope)
