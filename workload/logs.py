"""Log stream, event parsing, samples (batch forms of the streaming jobs)."""

from pyspark.sql import functions as F

from tidemark.operators import delta
from tidemark.streaming import events, logs, samples
from workload.oracle import big, full
from workload.registry import add

RULES = {"FATAL": ["57014"], "LOG": ["42P01", "57014"], "INFO": ["00000 "]}
_ADJ = "CASE WHEN sqlstate = '57014' THEN 'FATAL' WHEN sqlstate = '42P01' THEN 'LOG' WHEN sqlstate = '00000' THEN 'INFO' ELSE elevel END"
_RANK = "list_position(['DEBUG','INFO','NOTICE','WARNING','ERROR','LOG','FATAL','PANIC','ALERT','DISABLE'], {0})"
add(
    "adjust_level",
    lambda r: r.table("x_levels").select("event_id", logs.adjust_level(F.col("elevel"), F.col("sqlstate"), RULES).alias("elevel")),
    f"SELECT event_id, {_ADJ} AS elevel FROM x_levels",
)
add(
    "level_required",
    lambda r: r.table("x_levels").select(
        "event_id", *[logs.level_required(F.col("elevel"), m).alias(f"at_{m.lower()}") for m in ("ERROR", "LOG", "FATAL", "DISABLE")]
    ),
    "SELECT event_id, "
    + ", ".join(f"{_RANK.format('elevel')} >= {_RANK.format(repr(m))} AS at_{m.lower()}" for m in ("ERROR", "LOG", "FATAL", "DISABLE"))
    + " FROM x_levels",
)
add(
    "user_filter",
    lambda r: r.table("x_levels").where(logs.user_allowed(F.col("username"), ["u1", "u3"])).select("event_id", "username"),
    "SELECT event_id, username FROM x_levels WHERE username IS NULL OR username NOT IN ('u1', 'u3')",
)
add(
    "drop_control_messages",
    lambda r: r.table("x_levels").where(~logs.is_control(F.col("elevel"), F.col("message"))).select("event_id", "message"),
    "SELECT event_id, message FROM x_levels WHERE NOT (elevel = 'LOG' AND message = 'agent: snapshot requested')",
)
add(
    "route_log",
    lambda r: logs.routed(r.table("x_levels"), logs.Route("LOG", ("u2",), RULES)).select("event_id", "elevel", "username"),
    f"""
SELECT event_id, elevel, username FROM (SELECT event_id, username, {_ADJ} AS elevel FROM x_levels
       WHERE NOT (elevel = 'LOG' AND message = 'agent: snapshot requested'))
WHERE {_RANK.format("elevel")} >= {_RANK.format("'LOG'")} AND (username IS NULL OR username <> 'u2')""",
)
_HOST = "CASE WHEN client_addr IS NULL THEN '' WHEN client_addr LIKE '[%' OR client_addr NOT LIKE '%:%' THEN client_addr ELSE split_part(client_addr, ':', 1) || '(' || split_part(client_addr, ':', 2) || ')' END"
_PRE = f"""(strftime("timestamp", '%Y-%m-%d %H:%M:%S UTC') || ' [' || pid || '] ' || CASE WHEN username IS NULL THEN '' ELSE username || '@' || {_HOST} || '% ' END)"""
_LINES = "".join(
    f" || CASE WHEN {c} IS NULL THEN '' ELSE chr(10) || {_PRE} || '{t}:  ' || replace({c}, chr(10), chr(10) || chr(9)) END"
    for t, c in (("HINT", "hint"), ("CONTEXT", "context"), ("STATEMENT", "user_query"))
)
add(
    "format_log_line",
    lambda r: r.table("log").select(F.col("session_line_num").alias("id"), logs.format_log_line("%t [%p] %q%u@%r%% ", logs.VERBOSE).alias("line")),
    f"""
SELECT session_line_num AS id, {_PRE} || elevel || ':  ' || sqlstate || ': ' || replace(message, chr(10), chr(10) || chr(9))
       || CASE WHEN query_pos IS NULL THEN '' ELSE ' at character ' || query_pos END{_LINES} AS line FROM log""",
)

# --- events ------------------------------------------------------------------
_F3 = "CAST({0} || '.' || lpad(CAST(v % 1000 AS VARCHAR), 3, '0') AS DOUBLE)"


def _r3(c: str):
    return F.round(F.col(c).cast("double"), 3).alias(c)


add(
    "checkpoint_events",
    lambda r: events.checkpoint_events(r.table("log")).select(
        "instid", "start", "flags", "num_buffers", "xlog_added", "xlog_removed", "xlog_recycled", _r3("write_duration"), _r3("sync_duration"), _r3("total_duration")
    ),
    f"""
WITH s AS (SELECT *, LAG(kind) OVER w AS pk, LAG(v) OVER w AS pv, LAG(ts) OVER w AS pt FROM x_events WHERE kind IN (1, 2)
           WINDOW w AS (PARTITION BY instid ORDER BY ts, event_id))
SELECT instid, {full("pt")} AS "start", CASE WHEN pv % 2 = 0 THEN 'time' ELSE 'wal' END AS flags, v AS num_buffers, v % 7 AS xlog_added,
       v % 5 AS xlog_removed, v % 3 AS xlog_recycled, {_F3.format("v % 50")} AS write_duration, {_F3.format("0")} AS sync_duration, {_F3.format("v % 60")} AS total_duration
FROM s WHERE kind = 2 AND pk = 1 AND pv % 5 <> 0""",
)
_WHO = "'db' || CAST(dbid % 61 AS VARCHAR) AS database, 's' || CAST(user_id % 3 AS VARCHAR) AS schema, 't' || CAST(user_id % 211 AS VARCHAR) AS \"table\""
_START = full("make_timestamp(epoch_us(ts) - (v % 100) * 1000000 - 250000)")


def _if(test: str, value: str) -> str:
    return f"CASE WHEN {test} THEN {value} END"


def _two(a: str, b: str) -> str:
    return f"CASE v % 3 WHEN 0 THEN '' WHEN 1 THEN CAST({a} AS VARCHAR) ELSE CAST({a} AS VARCHAR) || ',' || CAST({b} AS VARCHAR) END"


add(
    "autovacuum_events",
    lambda r: events.autovacuum_events(r.table("log")),
    f"""
SELECT instid, {_START} AS "start", {_WHO}, v % 3 AS index_scans, v % 13 AS page_removed, v * 2 AS page_remain, v % 100 AS tbl_scan_pages,
       v % 100 + 0.25::DOUBLE AS tbl_scan_pages_ratio, v AS tup_removed, v * 3 AS tup_remain, v % 17 AS tup_dead, CAST(event_id AS DOUBLE) AS removable_cutoff,
       v % 9 + 0.125::DOUBLE AS read_rate, v % 8 + 0.5::DOUBLE AS write_rate, v AS page_hit, v % 31 AS page_miss, v % 7 AS page_dirty, v * 4 AS wal_records,
       v % 11 AS wal_page_images, v * 50 AS wal_bytes, v % 100 + 0.25::DOUBLE AS duration, {_if("v % 2 = 0", "v % 5")} AS tup_miss_dead,
       {_if("v % 2 = 0", "v % 3")} AS tup_miss_dead_pages, {_if("v % 3 = 0", "CAST(event_id + 5 AS DOUBLE)")} AS new_relfrozenxid,
       {_if("v % 5 = 0", "CAST(event_id + 9 AS DOUBLE)")} AS new_relminmxid, {_if("v % 2 = 1", "v % 6")} AS frozen_pages,
       {_if("v % 2 = 1", "v % 50 + 0.5::DOUBLE")} AS frozen_pages_ratio, {_if("v % 2 = 1", "v % 23")} AS frozen_tuples,
       {_if("v % 6 < 5", "1 + v % 4")} AS index_scan_ptn, {_if("v % 6 < 5", "v % 13")} AS dead_lp_pages, {_if("v % 6 < 5", "v % 40 + 0.75::DOUBLE")} AS dead_lp_pages_ratio,
       {_if("v % 6 < 5", "v % 19")} AS dead_lp, {_two("'ix_a'", "'ix b'")} AS index_names, {_two("v", "v")} AS index_pages_total, {_two("v % 5", "v % 5")} AS index_pages_new_del,
       {_two("v % 9", "v % 9")} AS index_pages_current_del, {_two("v % 4", "v % 4")} AS index_pages_reusable,
       {_if("v % 7 = 0", "v % 30 + 0.5::DOUBLE")} AS io_timings_read, {_if("v % 7 = 0", "v % 20 + 0.25::DOUBLE")} AS io_timings_write
FROM x_events WHERE kind = 4""",
)
add(
    "autoanalyze_events",
    lambda r: events.autoanalyze_events(r.table("log")),
    f"""
SELECT instid, {_START} AS "start", {_WHO}, v AS page_hit, v % 31 AS page_miss, v % 7 AS page_dirty, v % 9 + 0.125::DOUBLE AS read_rate,
       v % 8 + 0.5::DOUBLE AS write_rate, v % 100 + 0.25::DOUBLE AS duration, {_if("v % 7 = 1", "v % 30 + 0.5::DOUBLE")} AS io_timings_read,
       {_if("v % 7 = 1", "v % 20 + 0.25::DOUBLE")} AS io_timings_write
FROM x_events WHERE kind = 5 AND v % 2 = 1""",
)
_CANCEL = f"""
WITH s AS (SELECT *, LAG(kind) OVER w AS pk, LAG(event_id) OVER w AS pe, LAG(ts) OVER w AS pt FROM x_events WHERE kind = 3 OR (kind = 5 AND v % 2 = 0)
           WINDOW w AS (PARTITION BY instid, user_id % 4 ORDER BY ts, event_id)),
     c AS (SELECT CASE WHEN v % 2 = 0 THEN 'vacuum' ELSE 'analyze' END AS work, instid, {full("ts")} AS "timestamp", {_WHO},
                  CASE WHEN pk = 5 AND epoch_us(ts) - epoch_us(pt) <= 300000000 THEN 'ddl ' || pe END AS query FROM s WHERE kind = 3)
"""
add("cancel_events", lambda r: events.cancel_events(r.table("log")), _CANCEL + "SELECT * FROM c")
add(
    "autovacuum_cancels",
    lambda r: events.autovacuum_cancels(events.cancel_events(r.table("log"))),
    _CANCEL + "SELECT * EXCLUDE (work) FROM c WHERE work = 'vacuum'",
)
add(
    "cancel_requests",
    lambda r: events.cancel_records(r.table("log")).where("kind = 'request'").selectExpr("instid", "CAST(worker AS BIGINT) AS worker", "session_line_num AS id", "query"),
    "SELECT instid, 100 + user_id % 4 AS worker, event_id AS id, 'ddl ' || event_id AS query FROM x_events WHERE kind = 5 AND v % 2 = 0",
)

# --- samples -----------------------------------------------------------------
DAY = "1 day"
_CLASS = "CASE WHEN wait_event_type IN ('LWLock', 'Lock') THEN 'waiting' WHEN state = 'idle' THEN 'idle' WHEN state = 'idle in transaction' THEN 'idle_in_xact' WHEN state = 'active' THEN 'running' END"
add(
    "classify_backend",
    lambda r: r.table("x_backends").select("event_id", samples.classify_backend(F.col("wait_event_type"), F.col("state")).alias("class")),
    f'SELECT event_id, {_CLASS} AS "class" FROM x_backends',
)
add(
    "activity_rollup",
    lambda r: samples.activity_rollup(r.table("x_backends"), DAY),
    f"""
WITH s AS (SELECT date_trunc('day', sampled_at) AS d, instid, sampled_at, {", ".join(f"COUNT(*) FILTER ({_CLASS} = '{c}') AS {c}" for c in samples.STATES)}, COUNT(*) AS n
           FROM x_backends WHERE backend_type = 'client backend' AND NOT is_sampler GROUP BY ALL)
SELECT {full("CAST(d AS TIMESTAMP)")} AS snap_start, instid, {", ".join(f"{big(f'SUM({c})')} AS {c}" for c in samples.STATES)}, MAX(n) AS max_backends FROM s GROUP BY d, instid""",
)
add(
    "long_xact_rollup",
    lambda r: samples.long_xact_rollup(r.table("x_backends").withColumn("sampled_at", F.col("ts")), DAY),
    f"""
WITH s AS (SELECT date_trunc('day', ts) AS d, instid, client, pid, xact_start, CAST(epoch_us(ts) - epoch_us(xact_start) AS DOUBLE) / 1000000 AS sec,
                  CASE WHEN state = 'idle in transaction' THEN '<IDLE> in transaction' ELSE query END AS query, ts
           FROM x_backends WHERE backend_type = 'client backend' AND NOT in_vacuum),
     g AS (SELECT d, instid, client, pid, xact_start, arg_max(sec, ts) AS duration, arg_max(query, ts) AS query FROM s WHERE sec >= 1 GROUP BY ALL),
     k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY d, instid ORDER BY duration DESC, pid, xact_start) AS n FROM g)
SELECT {full("CAST(d AS TIMESTAMP)")} AS snap_start, instid, client, pid, {full("CAST(xact_start AS TIMESTAMP)")} AS "start", duration, query FROM k WHERE n <= 10""",
)
_DK = samples._DISK
add(
    "io_peak_and_overflow",
    lambda r: samples.disk_rollup(r.table("x_disks"), DAY),
    f"""
WITH s AS (SELECT *, epoch_us(sampled_at) // 1000000 - LAG(epoch_us(sampled_at) // 1000000) OVER w AS sec, {", ".join(f"{c} - LAG({c}) OVER w AS m_{c}" for c in _DK)}
           FROM x_disks WINDOW w AS (PARTITION BY instid, device ORDER BY sampled_at))
SELECT {full("CAST(date_trunc('day', sampled_at) AS TIMESTAMP)")} AS snap_start, instid, device,
       {", ".join(f"COALESCE(MAX(CASE WHEN sec > 0 AND m_{c} >= 0 THEN CAST(m_{c} AS DOUBLE) / sec END), 0) AS {o}" for c, o in (("rd_sectors", "device_rsps_max"), ("wr_sectors", "device_wsps_max")))},
       {", ".join(f"COUNT(*) FILTER (m_{c} < 0) AS overflow_{o}" for c, o in _DK.items())}
FROM s GROUP BY date_trunc('day', sampled_at), instid, device""",
)
add(
    "cpu_overflow",
    lambda r: samples.cpu_overflow(r.table("x_cpu").selectExpr("snapid", "instid", "u AS cpu_user", "s AS cpu_system", "i AS cpu_idle", "w AS cpu_iowait")),
    f"""
SELECT snapid, instid, u AS cpu_user, s AS cpu_system, i AS cpu_idle, w AS cpu_iowait,
       {", ".join(f"CAST(COALESCE({c} < LAG({c}) OVER q, FALSE) AS BIGINT) AS overflow_{n}" for c, n in (("u", "user"), ("s", "system"), ("i", "idle"), ("w", "iowait")))}
FROM x_cpu WINDOW q AS (PARTITION BY instid ORDER BY snapid)""",
)
for _name, _keep, _qid in (("wait_profile", True, "queryid"), ("wait_profile_without_queries", False, "CAST(0 AS BIGINT)")):
    add(
        _name,
        lambda r, keep=_keep: samples.wait_profile(r.table("x_waits"), DAY, keep),
        f"""
WITH g AS (SELECT date_trunc('day', sampled_at) AS t, instid, dbid, userid, {_qid} AS queryid, backend_type, event_type, event, COUNT(*) AS n FROM x_waits WHERE event IS NOT NULL GROUP BY ALL)
SELECT {full("CAST(t AS TIMESTAMP)")} AS snap_start, instid, dbid, userid, queryid, backend_type, event_type, event,
       {big("SUM(n) OVER (PARTITION BY instid, dbid, userid, queryid, backend_type, event_type, event ORDER BY t)")} AS "count" FROM g""",
    )


def _kind(k: str, c: str) -> str:
    times = " * 512" if c in ("reads", "writes") else ""
    total = f"COALESCE(SUM({c}{times}) FILTER (kind = '{k}'), 0)"
    return f"{total if c.endswith('time') else big(total)} AS {k}_{c}"


add(
    "rusage_rollup",
    lambda r: samples.rusage_rollup(r.table("x_execs"), None),
    f"""SELECT instid, dbid, userid, queryid, toplevel, {", ".join(_kind(k, c) for k in ("plan", "exec") for c in samples._USAGE)}
FROM x_execs GROUP BY instid, dbid, userid, queryid, toplevel""",
)
_ROOM = "least(999 - length(a), 100)"
add(
    "xact_query_history",
    lambda r: samples.xact_query_history(r.table("x_queries")).selectExpr("instid", "pid", "CAST(xact AS BIGINT) AS xact", "queries"),
    f"""
WITH l AS (SELECT instid, pid, CAST(xact AS BIGINT) AS xact, list(query ORDER BY executed_at) AS qs FROM x_queries GROUP BY ALL)
SELECT instid, pid, xact, list_reduce(qs, lambda a, q: a || CASE WHEN length(q) <= {_ROOM} THEN CASE WHEN q LIKE '%;' THEN q ELSE q || ';' END
       WHEN {_ROOM} > 4 THEN left(q, {_ROOM} - 4) || '...;' ELSE '' END, '') AS queries FROM l""",
)
add(
    "statement_transactions",
    lambda r: samples.with_transactions(r.table("x_statements"), width=9999).select("instid", "pid", "executed_at", "query", "xact"),
    """
WITH s AS (SELECT *, CASE WHEN query = 'BEGIN' THEN 1 WHEN query = 'COMMIT' THEN 0 END AS mark FROM x_statements WHERE query <> 'savepoint s'),
     t AS (SELECT *, COALESCE(LAST_VALUE(mark IGNORE NULLS) OVER (PARTITION BY instid, pid ORDER BY executed_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS state FROM s)
SELECT instid, pid, executed_at, query, CAST(SUM(CASE WHEN mark = 1 OR (mark IS NULL AND state = 0) THEN 1 ELSE 0 END)
       OVER (PARTITION BY instid, pid ORDER BY executed_at) AS BIGINT) AS xact FROM t""",
)
add(
    "chunked_previous",
    lambda r: delta.with_previous(r.table("x_rel"), ["instid", "tbl"], ["n", "p"], scope_length=None, chunk=7).select(
        "snapid", "tbl", (F.col("n") - F.col("prev_n")).alias("dn"), (F.col("p") - F.col("prev_p")).alias("dp")
    ),
    "SELECT snapid, tbl, n - LAG(n) OVER w AS dn, p - LAG(p) OVER w AS dp FROM x_rel WINDOW w AS (PARTITION BY instid, tbl ORDER BY snapid)",
)
