"""Collection, registration, retention and scalar functions."""

from pyspark.sql import functions as F

from tidemark.functions import clock, numeric, text
from tidemark.sources import collect, register, retention, sink
from workload.oracle import big, div, full, sec, size_text, tps
from workload.registry import add

SNAP = ("snapid",)

# --- collection --------------------------------------------------------------
_DBC = (
    "size, age, xact_commit, xact_rollback, blks_hit, tup_returned, tup_fetched, tup_inserted, tup_updated, tup_deleted, confl_tablespace, "
    "confl_lock, confl_snapshot, confl_bufferpin, confl_deadlock, temp_files, temp_bytes, deadlocks, blk_read_time, blk_write_time"
)
add(
    "ingest_database",
    lambda r: collect.ingest_database(r.table("c_databases"), ["db3", "db5"], SNAP),
    f"""
SELECT snapid, dbid, datname AS name, {_DBC.replace("age,", "CAST(CASE WHEN in_recovery THEN 0 ELSE age END AS BIGINT) AS age,")}, blks_fetched - blks_hit AS blks_read
FROM c_databases WHERE datallowconn AND datname NOT IN ('db3', 'db5')""",
)
add(
    "ingest_setting",
    lambda r: collect.ingest_setting(r.table("c_settings"), SNAP),
    "SELECT snapid, name, setting, unit, source FROM c_settings WHERE source NOT IN ('client', 'default', 'session') AND setting <> boot_val",
)
add(
    "ingest_role",
    lambda r: collect.ingest_role(r.table("c_roles"), SNAP),
    "SELECT snapid, oid AS userid, rolname AS name FROM c_roles",
)
_TIMES = "shared_blk_read_time, shared_blk_write_time, local_blk_read_time, local_blk_write_time, temp_blk_read_time, temp_blk_write_time"


def _leaders(table: str, by: str, ties: str, columns: str) -> str:
    return f"""
SELECT {columns} FROM (SELECT s.*, ROW_NUMBER() OVER (PARTITION BY s.snapid ORDER BY {by} DESC, {ties}) AS k
  FROM {table} s JOIN c_roles r ON r.snapid = s.snapid AND r.oid = s.userid WHERE r.rolname NOT IN ('role2')) WHERE k <= 30"""


def _short(df):
    return df.select("snapid", "dbid", "userid", "queryid", *[c for c in df.columns if c in ("planid", "calls", "total_exec_time", "total_plan_time", "total_time", "query", "plans") or c.endswith("_blk_read_time") or c.endswith("_blk_write_time")])


add(
    "ingest_statement",
    lambda r: _short(collect.ingest_statement(r.table("statement"), r.table("c_roles"), ["role2"], scope=SNAP)),
    _leaders("statement", "total_exec_time", "dbid, userid, queryid", f"snapid, dbid, userid, queryid, query, plans, total_plan_time / 1000 AS total_plan_time, calls, total_exec_time / 1000 AS total_exec_time, {_TIMES}"),
)
add(
    "ingest_statement_all",
    lambda r: collect.ingest_statement(r.table("statement"), r.table("c_roles"), ["role2"], scope=SNAP, n=10**9).select("snapid", "dbid", "userid", "queryid", "calls"),
    "SELECT s.snapid, dbid, userid, queryid, calls FROM statement s JOIN c_roles r ON r.snapid = s.snapid AND r.oid = s.userid WHERE r.rolname <> 'role2'",
)
add(
    "ingest_plan",
    lambda r: _short(collect.ingest_plan(r.table("plan"), r.table("c_roles"), ["role2"], scope=SNAP)),
    _leaders("plan", "total_time", "dbid, userid, queryid, planid", f"snapid, dbid, userid, queryid, planid, calls, total_time / 1000 AS total_time, {_TIMES}"),
)
_RU = "plan_reads, plan_writes, plan_user_time, plan_system_time, exec_reads, exec_writes, exec_user_time, exec_system_time"
add(
    "ingest_rusage",
    lambda r: collect.ingest_rusage(r.table("rusage"), r.table("c_roles"), ["role2"], scope=SNAP).select("snapid", "dbid", "userid", "queryid", *_RU.split(", ")),
    _leaders("rusage", "exec_user_time", "dbid, userid, queryid", f"snapid, dbid, userid, queryid, {_RU}"),
)
NOW = "2024-01-31 00:00:00"
add(
    "ingest_lock_edges",
    lambda r: collect.ingest_lock_edges(
        r.table("c_locks"), r.table("c_activity"), r.table("c_relations"), r.table("c_namespaces"), r.table("c_prepared"),
        r.table("c_last"), F.lit(NOW).cast("timestamp"), 10 * 86400.0,
    ),
    f"""
WITH t AS (SELECT DISTINCT pid AS blockee_pid, unnest(blocking_pids) AS blocker_pid, transactionid, relation, waitstart
           FROM c_locks WHERE NOT granted AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(waitstart) > 864000000000)
SELECT a.datid AS dbid, n.nspname, CAST(t.relation AS VARCHAR) AS relname, a.application_name AS blocker_appname, a.client_addr AS blocker_addr,
       a.client_hostname AS blocker_hostname, {big("a.client_port")} AS blocker_port, t.blockee_pid, t.blocker_pid, p.gid AS blocker_gid, a.wait_event_type, a.wait_event,
       ((epoch_us(TIMESTAMP '{NOW}') - epoch_us(t.waitstart) + 500000) // 1000000) * 1000000 AS duration, a.query AS blockee_query,
       CASE WHEN p.gid IS NOT NULL THEN '(xact is detached from session)' WHEN l.queries IS NULL THEN '(library might not have been loaded)' ELSE l.queries END AS blocker_query
FROM t LEFT JOIN c_prepared p ON p.transaction = t.transactionid LEFT JOIN c_activity a ON a.pid = t.blockee_pid
     LEFT JOIN c_last l ON l.pid = t.blocker_pid LEFT JOIN c_relations c ON c.oid = t.relation LEFT JOIN c_namespaces n ON n.oid = c.relnamespace""",
)
_SAME = "n_tup_ins, n_tup_upd, n_tup_del, n_tup_hot_upd, n_live_tup, n_dead_tup, n_mod_since_analyze"
add(
    "ingest_relation_rollup",
    lambda r: collect.ingest_relation_rollup(r.table("c_relations"), r.table("c_indexes"), r.table("c_namespaces"), ["app"]).drop(
        "last_vacuum", "last_autovacuum", "last_analyze", "last_autoanalyze"
    ),
    f"""
WITH i AS (SELECT indrelid, COUNT(*) FILTER (indisvalid) AS good, MAX(indexrelid) FILTER (indisvalid) AS last, SUM(numscans) FILTER (indisvalid) AS s,
                  SUM(tuples_fetched) FILTER (indisvalid) AS f, SUM(blks_fetched - blks_hit) FILTER (indisvalid) AS r, SUM(blks_hit) FILTER (indisvalid) AS h
           FROM c_indexes GROUP BY indrelid)
SELECT CAST(NULL AS BIGINT) AS dbid, c.oid AS tbl, {big("c.relnamespace")} AS nsp, {big("c.reltablespace")} AS tbs, c.relname AS name, {big("c.reltoastrelid")} AS toastrelid,
       {big("x.last")} AS toastidxid, c.relkind, {big("c.relpages")} AS relpages, CAST(c.reltuples AS DOUBLE) AS reltuples, array_to_string(c.reloptions, ',') AS reloptions, c.size,
       c.numscans AS seq_scan, c.tuples_returned AS seq_tup_read, {big("i.s")} AS idx_scan, {big("i.f + c.tuples_fetched")} AS idx_tup_fetch, {_SAME.replace("n_", "c.n_", 1).replace(", n_", ", c.n_")},
       c.blks_fetched - c.blks_hit AS heap_blks_read, c.blks_hit AS heap_blks_hit, {big("i.r")} AS idx_blks_read, {big("i.h")} AS idx_blks_hit,
       t.blks_fetched - t.blks_hit AS toast_blks_read, t.blks_hit AS toast_blks_hit, {big("x.r")} AS tidx_blks_read, {big("x.h")} AS tidx_blks_hit
FROM c_relations c JOIN c_namespaces n ON n.oid = c.relnamespace LEFT JOIN i ON i.indrelid = c.oid LEFT JOIN c_relations t ON t.oid = c.reltoastrelid
     LEFT JOIN i x ON x.indrelid = c.reltoastrelid
WHERE c.relkind IN ('r', 't') AND n.nspname <> 'app' AND COALESCE(i.good, 1) > 0 AND COALESCE(x.good, 1) > 0""",
)
add(
    "ingest_column_stats",
    lambda r: collect.ingest_column_stats(r.table("c_attributes"), r.table("c_statistics"), r.table("c_relations"), r.table("c_namespaces"), ["app"]),
    """
SELECT CAST(NULL AS BIGINT) AS dbid, a.attrelid AS tbl, CAST(a.attnum AS BIGINT) AS attnum, a.attname AS name, a.type, CAST(a.attstattarget AS BIGINT) AS stattarget,
       a.attstorage AS storage, a.attnotnull AS isnotnull, a.attisdropped AS isdropped, CAST(s.stawidth AS BIGINT) AS avg_width, CAST(s.stadistinct AS DOUBLE) AS n_distinct,
       CAST(CASE WHEN stakind1 = 3 THEN stanumbers1[1] WHEN stakind2 = 3 THEN stanumbers2[1] WHEN stakind3 = 3 THEN stanumbers3[1] WHEN stakind4 = 3 THEN stanumbers4[1] END AS DOUBLE) AS correlation
FROM c_attributes a JOIN c_relations c ON c.oid = a.attrelid JOIN c_namespaces n ON n.oid = c.relnamespace
     LEFT JOIN c_statistics s ON s.starelid = a.attrelid AND s.staattnum = a.attnum AND NOT s.stainherit
WHERE a.attnum > 0 AND c.relkind IN ('r', 't') AND n.nspname <> 'app'""",
)
add(
    "ingest_index",
    lambda r: collect.ingest_index(
        r.table("c_indexes"),
        # the catalog lists indexes as relations too
        r.table("c_relations").unionByName(
            r.table("c_indexes").selectExpr("indexrelid AS oid", "indrelid AS size", "'i' AS relkind", "concat('ix', indexrelid) AS relname", "403L AS relam"), allowMissingColumns=True
        ),
        r.table("c_namespaces"), ["app"],
    ).select("idx", "tbl", "name", "relam", "isunique", "isprimary", "isclustered", "isvalid", "indexdef", "size", "idx_scan", "idx_tup_read", "idx_tup_fetch", "idx_blks_read", "idx_blks_hit"),
    f"""
SELECT {big("x.indexrelid")} AS idx, x.indrelid AS tbl, 'ix' || x.indexrelid AS name, CAST(403 AS BIGINT) AS relam, indisunique AS isunique, indisprimary AS isprimary,
       indisclustered AS isclustered, indisvalid AS isvalid, indexdef, x.indrelid AS size, x.numscans AS idx_scan, x.tuples_returned AS idx_tup_read, x.tuples_fetched AS idx_tup_fetch,
       x.blks_fetched - x.blks_hit AS idx_blks_read, x.blks_hit AS idx_blks_hit
FROM c_indexes x JOIN c_relations c ON c.oid = x.indrelid JOIN c_namespaces n ON n.oid = c.relnamespace WHERE c.relkind IN ('r', 't') AND n.nspname <> 'app'""",
)
add(
    "ingest_schema",
    lambda r: collect.ingest_schema(r.table("schema").selectExpr("snapid", "dbid", "nsp AS oid", "name AS nspname"), ["pg_toast"], ("snapid", "dbid")),
    "SELECT snapid, dbid, CAST(nsp AS BIGINT) AS nsp, name FROM schema WHERE name <> 'pg_toast'",
)
add(
    "ingest_inherits",
    lambda r: collect.ingest_inherits(
        r.table("c_relations").where("reltoastrelid > 0").selectExpr("oid AS inhrelid", "reltoastrelid AS inhparent", "relpages AS inhseqno"),
        r.table("c_relations"), r.table("c_namespaces"), ["app"],
    ),
    f"""SELECT c.oid AS inhrelid, {big("c.reltoastrelid")} AS inhparent, {big("c.relpages")} AS inhseqno FROM c_relations c JOIN c_namespaces n ON n.oid = c.relnamespace
WHERE c.reltoastrelid > 0 AND n.nspname <> 'app'""",
)
add(
    "ingest_function",
    lambda r: collect.ingest_function(
        r.table("function").join(r.table("c_namespaces").selectExpr("oid AS nsp", "nspname AS schemaname"), "nsp").drop("nsp"), r.table("c_namespaces"), ["app"]
    ).select("funcid", "nsp", "funcname", "calls", "total_time", "self_time"),
    "SELECT funcid, CAST(nsp AS BIGINT) AS nsp, funcname, calls, total_time, self_time FROM function JOIN c_namespaces n ON n.oid = nsp WHERE n.nspname <> 'app'",
)
_FILE = "printf('%08X%08X%08X', 1, CAST(((cv * 20000 - 1) // 16777216) // 256 AS BIGINT), CAST(((cv * 20000 - 1) // 16777216) % 256 AS BIGINT))"


def _senders(r):
    marks = r.table("xlog").join(r.table("x_marks").select("snapid", "instid", "n"), "snapid")
    file = collect.wal_file(F.col("location"), F.lit(1))
    return marks.select(
        "snapid", (F.col("instid") == 2).alias("in_recovery"), F.lit(7).alias("pid"), F.lit(10).alias("usesysid"), F.lit("rep").alias("usename"), F.lit("app").alias("application_name"),
        *[F.lit(None).cast("string").alias(c) for c in ("client_addr", "client_hostname", "state", "sync_state")],
        *[F.lit(None).cast("int").alias(c) for c in ("client_port", "sync_priority")], F.lit(None).cast("bigint").alias("backend_xmin"), F.lit(None).cast("timestamp").alias("backend_start"),
        *[F.col("location").alias(f"{k}_lsn") for k in ("current", "sent", "write", "flush", "replay")], *[file.alias(f"{k}_file") for k in ("current", "sent", "write", "flush", "replay")],
        F.when(F.col("n") > 170, F.col("n")).alias("write_lag"), F.lit(None).cast("bigint").alias("flush_lag"), F.col("n").alias("replay_lag"),
    )


add(
    "ingest_replication",
    lambda r: collect.ingest_replication(_senders(r), SNAP).select("snapid", "procpid", "current_location", "replay_location", "write_lag", "flush_lag", "replay_lag"),
    f"""
WITH s AS (SELECT m.*, x.location || ' (' || CASE WHEN instid = 2 THEN 'N/A' ELSE {_FILE} END || ')' AS place FROM x_marks m JOIN xlog x USING (snapid))
SELECT snapid, CAST(7 AS BIGINT) AS procpid, place AS current_location, place AS replay_location, CASE WHEN n > 170 THEN n ELSE 0 END AS write_lag, CAST(0 AS BIGINT) AS flush_lag, n AS replay_lag FROM s""",
)
add(
    "ingest_plain_counters",
    lambda r: collect.ingest_plain(r.table("bgwriter"), "bgwriter", SNAP),
    "SELECT snapid, buffers_clean, maxwritten_clean, buffers_alloc FROM bgwriter",
)
add(
    "ingest_sampled_facts",
    lambda r: collect.ingest_plain(r.table("activity"), "activity", SNAP),
    f"SELECT snapid, {', '.join(f'{big(c)} AS {c}' for c in ('idle', 'idle_in_xact', 'waiting', 'running', 'max_backends'))} FROM activity",
)
add(
    "ingest_xlog",
    lambda r: collect.ingest_xlog(r.table("xlog").join(r.table("snapshot").selectExpr("snapid", "instid = 2 AS in_recovery"), "snapid"), SNAP),
    "SELECT snapid, location, xlogfile FROM xlog JOIN snapshot USING (snapid) WHERE instid <> 2",
)
_HT = ("statements", "wait_sampling", "rusage")


def _source(r, name):
    return r.table("ht_info").select("snapid", F.col(f"{name}_dealloc").alias("dealloc"), F.col(f"{name}_reset").alias("stats_reset"))


add(
    "ingest_ht_info",
    lambda r: collect.ingest_ht_info(_source(r, "wait_sampling"), _source(r, "rusage"), _source(r, "statements"), SNAP),
    f"SELECT snapid, {', '.join(f'{s}_dealloc, {full(f'{s}_reset')} AS {s}_reset' for s in _HT)} FROM ht_info",
)
add(
    "device_tablespaces",
    lambda r: register.device_tablespaces(r.table("tablespace"), SNAP),
    """SELECT snapid, device, split_part(device, ':', 1) AS device_major, split_part(device, ':', 2) AS device_minor, string_agg(name, ',' ORDER BY name) AS names
FROM (SELECT DISTINCT snapid, device, name FROM tablespace) t GROUP BY snapid, device""",
)

# --- writing rules -----------------------------------------------------------
add(
    "known_database_guard",
    lambda r: sink.known_databases(r.table("statement"), r.table("database")).select("snapid", "dbid", "userid", "queryid"),
    "SELECT snapid, dbid, userid, queryid FROM statement s WHERE EXISTS (SELECT 1 FROM database d WHERE d.snapid = s.snapid AND d.dbid = s.dbid)",
)
add(
    "date_partition_stamp",
    lambda r: r.table("table").drop("date").join(r.table("snapshot").select("snapid", F.to_date("time").alias("date")), "snapid").select("snapid", "tbl", "date"),
    """SELECT snapid, tbl, CAST(CAST(time AS DATE) AS VARCHAR) AS date FROM "table" JOIN snapshot USING (snapid)""",
)


def _servers(r):
    known = r.table("instance")
    shards = r.table("x_events").selectExpr("concat('sys', CAST(user_id % 9 AS STRING)) AS name", "'18.0' AS pg_version").distinct()
    return shards.select(
        "name", F.concat(F.lit("host"), F.substring("name", 4, 9)).alias("hostname"), (F.substring("name", 4, 9).cast("int") + 5431).alias("port"), "pg_version",
        *[F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("xlog_file_size", "page_size", "page_header_size", "htup_header_size", "item_id_size")],
    )


add(
    "register_instance",
    lambda r: register.register_instances(r.table("instance"), _servers(r)).select("instid", "name", "hostname", "port", "pg_version"),
    """
WITH n AS (SELECT DISTINCT user_id % 9 AS k FROM x_events),
     f AS (SELECT k, ROW_NUMBER() OVER (ORDER BY k) AS rn FROM n WHERE k NOT IN (1, 2))
SELECT instid, name, hostname, CAST(port AS BIGINT) AS port, '18.0' AS pg_version FROM instance
UNION ALL SELECT 2 + rn, 'sys' || k, 'host' || k, 5431 + k, '18.0' FROM f""",
)
add(
    "default_thresholds",
    lambda r: register.with_default_thresholds(
        r.table("alert"), r.table("instance").unionByName(r.table("instance").withColumn("instid", F.col("instid") + 2))
    ).select("instid", "commit_tps", "garbage_percent", "loadavg_15min", "swap_size", "enable_alert"),
    """
SELECT instid, commit_tps, CAST(garbage_percent AS BIGINT) AS garbage_percent, CAST(loadavg_15min AS DOUBLE) AS loadavg_15min, CAST(swap_size AS BIGINT) AS swap_size, enable_alert FROM alert
UNION ALL SELECT instid + 2, 1000, 30, 5.0, 1000000, TRUE FROM instance""",
)
add(
    "hardware_change_append",
    lambda r: register.changed_hardware(
        r.table("meminfo"),
        r.table("x_marks").groupBy("instid").agg(F.max("time").alias("timestamp"), F.max_by("v", "d").alias("v"))
        .select("instid", "timestamp", F.when(F.col("instid") == 1, F.col("v") * 100000).otherwise(F.lit(5)).alias("mem_total")),
        "meminfo",
    ),
    f"""
WITH n AS (SELECT instid, MAX(time) AS time, CASE WHEN instid = 1 THEN arg_max(v, d) * 100000 ELSE 5 END AS mem_total FROM x_marks GROUP BY instid),
     l AS (SELECT instid, arg_max(mem_total, "timestamp") AS last FROM meminfo GROUP BY instid)
SELECT n.instid, {full("n.time")} AS "timestamp", n.mem_total FROM n LEFT JOIN l USING (instid) WHERE n.mem_total IS DISTINCT FROM l.last""",
)

# --- retention ---------------------------------------------------------------
CUT = "2024-01-11 09:30:00"


def _cut():
    return F.lit(CUT).cast("timestamp")


add(
    "del_snapshot",
    lambda r: retention.without_snapshot(r.table("database"), 21).select("snapid", "dbid", "size"),
    "SELECT snapid, dbid, size FROM database WHERE snapid <> 21",
)
add(
    "del_snapshot_before_facts",
    lambda r: retention.kept_facts(r.table("database"), retention.kept_snapshots(r.table("snapshot"), _cut())).select("snapid", "dbid", "size"),
    f"SELECT snapid, dbid, size FROM database WHERE snapid IN (SELECT snapid FROM snapshot WHERE time >= '{CUT}')",
)
add(
    "del_snapshot_before_events",
    lambda r: retention.kept_events(r.table("checkpoint"), "checkpoint", retention.kept_snapshots(r.table("snapshot"), _cut())).select("instid", "start", "num_buffers"),
    f"""SELECT instid, {full('"start"')} AS "start", num_buffers FROM checkpoint WHERE "start" >= (SELECT MIN(time) FROM snapshot WHERE time >= '{CUT}')""",
)
add(
    "del_repolog",
    lambda r: retention.kept_log(r.table("log"), _cut()).select("instid", "timestamp", "session_line_num"),
    f"""SELECT instid, {full("ts")} AS "timestamp", event_id AS session_line_num FROM x_events WHERE ts >= '{CUT}'""",
)
add(
    "retention_cutoff",
    lambda r: r.table("x_events").select("event_id", retention.cutoff(7, F.to_date("ts")).alias("cutoff")),
    f"SELECT event_id, {full('date_trunc(chr(100) || chr(97) || chr(121), ts) - INTERVAL 7 DAY')} AS cutoff FROM x_events",
)

# --- functions ---------------------------------------------------------------
add(
    "number_functions",
    lambda r: r.table("x_rel").select(
        "snapid", "tbl",
        numeric.tps(F.col("p"), F.col("n") * 1_000_003).alias("tps"), numeric.div(F.col("q"), F.col("n") - 2).alias("div"),
        numeric.sub(F.when(F.col("r") > 0, F.col("n")), F.col("q")).alias("sub"), numeric.np_sub(F.col("q"), F.col("n") * 20).alias("np_sub"),
        numeric.xid_sub(F.col("n"), F.col("q")).alias("xid_sub"), numeric.idiv(F.col("n") - F.col("q"), 7).alias("idiv"),
        numeric.unwrap(F.col("n"), F.col("r")).alias("unwrapped"), numeric.align8(F.col("q")).alias("aligned"), numeric.mib(F.col("n") * 900000 - F.col("p")).alias("mib"),
    ),
    f"""
SELECT snapid, tbl, {tps("p", "n * 1000003")} AS tps, {div("q", "n - 2")} AS div, COALESCE(CASE WHEN r > 0 THEN n END, 0) - q AS sub,
       CASE WHEN q - n * 20 < 0 THEN q ELSE q - n * 20 END AS np_sub, CAST(n - q AS DOUBLE) AS xid_sub, CAST(trunc((n - q) / 7) AS BIGINT) AS idiv,
       n + r * 4294967296 AS unwrapped, ((q + 7) // 8) * 8 AS aligned, CAST(trunc((n * 900000 - p) / 1048576) AS BIGINT) AS mib FROM x_rel""",
)
_BYTES = "p * p % 900000000000000"
add(
    "size_functions",
    lambda r: r.table("x_rel").withColumn("b", F.expr(f"CAST(p AS DECIMAL(38,0)) * p % 900000000000000").cast("bigint")).select(
        "snapid", "tbl", numeric.size_pretty(F.col("b")).alias("pretty"), numeric.size_pretty_nearest(F.col("b")).alias("nearest"), numeric.size_pretty_system(F.col("n") * 700).alias("system")
    ),
    f"""
WITH b AS (SELECT snapid, tbl, n * 700 AS s, CAST(CAST(p AS HUGEINT) * p % 900000000000000 AS BIGINT) AS b FROM x_rel)
SELECT snapid, tbl, {size_text("b")} AS pretty,
       CASE WHEN b < 10240 THEN b || ' bytes' WHEN b < 10485760 THEN (b + 512) // 1024 || ' KiB' WHEN b < 10737418240 THEN (b + 524288) // 1048576 || ' MiB'
            WHEN b < 10995116277760 THEN (b + 536870912) // 1073741824 || ' GiB' ELSE (b + 549755813888) // 1099511627776 || ' TiB' END AS nearest,
       {size_text("s").replace("KiB", "kB").replace("MiB", "MB").replace("GiB", "GB").replace("TiB", "TB")} AS system FROM b""",
)
add(
    "lsn_diff",
    lambda r: r.table("x_rel").select(
        "snapid", "tbl", text.lsn_diff(F.expr("concat(hex(q), '/', hex(p % 4294967296))"), F.expr("concat(hex(n), '/', hex(q))")).alias("diff"), text.hex_to_long(F.hex("p")).alias("converted")
    ),
    "SELECT snapid, tbl, CAST(CAST(q - n AS HUGEINT) * 4294967296 + p % 4294967296 - q AS DOUBLE) AS diff, p AS converted FROM x_rel",
)
add(
    "fillfactor",
    lambda r: r.table("table").select("snapid", "tbl", text.fillfactor(F.col("reloptions")).alias("heap"), text.fillfactor(F.col("reloptions"), F.lit(403)).alias("btree"), text.fillfactor(F.col("reloptions"), 405).alias("hash")),
    """
WITH f AS (SELECT snapid, tbl, CAST(NULLIF(regexp_extract(array_to_string(reloptions, '/'), 'fillfactor=([0-9]+)', 1), '') AS BIGINT) AS f FROM "table")
SELECT snapid, tbl, COALESCE(f, 100) AS heap, COALESCE(f, 90) AS btree, COALESCE(f, 70) AS hash FROM f""",
)
add(
    "array_functions",
    lambda r: r.table("autovacuum").groupBy("instid", "database").agg(text.merged_arrays(F.col("index_names")).alias("merged"), F.max(F.array_join(text.array_unique("index_names"), "+")).alias("one")),
    """
SELECT instid, database, COALESCE((SELECT string_agg(n, ',' ORDER BY n) FROM (SELECT DISTINCT unnest(names) AS n)), '') AS merged, one
FROM (SELECT instid, database, flatten(list(index_names)) AS names, MAX(array_to_string(index_names, '+')) AS one FROM autovacuum GROUP BY instid, database) g""",
)
add(
    "time_functions",
    lambda r: r.table("x_events").select(
        "event_id", clock.minute_label(F.col("ts")).alias("minute"), clock.to_second(F.col("ts")).alias("second"), clock.interval_label(F.col("v") * 1234567).alias("label"),
        clock.span(F.col("ts"), F.date_trunc("day", "ts")).alias("span"),
    ),
    f"""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute, {sec("ts")} AS second,
       lpad(CAST(v * 1234567 // 3600000000 AS VARCHAR), 2, '0') || ':' || lpad(CAST((v * 1234567 // 60000000) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((v * 1234567 // 1000000) % 60 AS VARCHAR), 2, '0')
         || '.' || lpad(CAST(v * 1234567 % 1000000 AS VARCHAR), 6, '0') AS label, epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS span FROM x_events""",
)
add(
    "text_functions",
    lambda r: r.table("index").where(text.has_index_keys(F.col("indexdef"))).select(
        "snapid", "idx", text.index_keys(F.col("indexdef")).alias("keys"), text.qualified(F.lit("db"), F.col("name"), F.col("tbl").cast("string")).alias("label"), text.host(F.lit("10.0.0.1/32")).alias("host")
    ),
    """SELECT snapid, idx, regexp_extract(indexdef, 'USING[^\\(]+\\((.*)\\)', 1) AS keys, 'db.' || name || '.' || tbl AS label, '10.0.0.1' AS host FROM "index" WHERE indexdef LIKE '%USING%'""",
)
add(
    "snap_date",
    lambda r: r.table("x_snap").select("snapid").join(r.table("snapshot").select("snapid", F.to_date("time").alias("snap_date")), "snapid"),
    "SELECT snapid, CAST(CAST(time AS DATE) AS VARCHAR) AS snap_date FROM snapshot",
)
