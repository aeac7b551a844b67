"""Relations, events, statements, waits, replication, hardware and settings."""

from tidemark.plans import hardware, maintenance, relations, replication, statements, waits
from workload.oracle import B, E, avg3, big, div, div3, full, lsn, mib, mins, pct, ratio, sec, size_text, sub, units
from workload.registry import add

# --- pre-joined views --------------------------------------------------------
_VT = """
SELECT t.snapid, d.name AS dbname, s.name AS nspname, t.name AS relname, t.dbid, t.tbl, t.nsp, t.size, t.n_live_tup
FROM "table" t JOIN database d ON d.snapid = t.snapid AND d.dbid = t.dbid
     JOIN schema s ON s.snapid = t.snapid AND s.dbid = t.dbid AND s.nsp = t.nsp"""
add(
    "view_tables",
    lambda r: relations.view_tables(r).selectExpr(
        "snapid", "database AS dbname", "schema AS nspname", "`table` AS relname", "dbid", "tbl", "nsp", "size", "n_live_tup"
    ),
    _VT,
)
add(
    "view_indexes",
    lambda r: relations.view_indexes(r).selectExpr(
        "snapid", "database AS dbname", "schema AS nspname", "`table` AS relname", "`index` AS indname", "dbid", "tbl", "idx", "size"
    ),
    """
SELECT i.snapid, d.name AS dbname, s.name AS nspname, t.name AS relname, i.name AS indname, i.dbid, i.tbl, i.idx, i.size
FROM "index" i JOIN "table" t ON t.snapid = i.snapid AND t.dbid = i.dbid AND t.tbl = i.tbl
     JOIN schema s ON s.snapid = t.snapid AND s.dbid = t.dbid AND s.nsp = t.nsp
     JOIN database d ON d.snapid = i.snapid AND d.dbid = i.dbid""",
)


def tables(hidden: str = "") -> str:
    """FROM clause: named tables at the end (e), the same tables at the begin (b)."""
    keep = f" AND s.name NOT IN ({hidden})" if hidden else ""
    return f"""
(SELECT t.*, d.name AS datname, s.name AS nspname FROM "table" t
  JOIN database d ON d.snapid = t.snapid AND d.dbid = t.dbid
  JOIN schema s ON s.snapid = t.snapid AND s.dbid = t.dbid AND s.nsp = t.nsp
  WHERE t.snapid = {E}{keep}) e
LEFT JOIN (SELECT * FROM "table" WHERE snapid = {B}) b ON b.dbid = e.dbid AND b.nsp = e.nsp AND b.tbl = e.tbl"""


USER = "'pg_catalog', 'pg_toast', 'information_schema'"
NAMES = "e.datname, e.nspname, e.name AS relname"
_TOAST = f"{sub('toast_blks_read')} + {sub('tidx_blks_read')}"
add(
    "disk_usage_table",
    lambda r: relations.disk_usage_table(r, B, E),
    f"""
SELECT {NAMES}, {mib("e.size")} AS size, {sub("heap_blks_read")} AS table_reads, {sub("idx_blks_read")} AS index_reads,
       {_TOAST} AS toast_reads FROM {tables(USER)}""",
)
add(
    "disk_usage_table_top10",
    lambda r: relations.disk_usage_table(r, B, E, limit=relations.TOP_DISK_USAGE),
    f"""
SELECT * EXCLUDE (total, n1, n2, n3) FROM (
SELECT {NAMES}, {mib("e.size")} AS size, {sub("heap_blks_read")} AS table_reads, {sub("idx_blks_read")} AS index_reads,
       {_TOAST} AS toast_reads, {sub("heap_blks_read")} + {sub("idx_blks_read")} + {_TOAST} AS total, e.datname AS n1, e.nspname AS n2, e.name AS n3
FROM {tables(USER)}) ORDER BY total DESC, n1, n2, n3 LIMIT 10""",
)
_UPD = f"{sub('n_tup_ins')} + {sub('n_tup_upd')} + {sub('n_tup_del')}"
_UPDQ = f"""
SELECT {NAMES}, {sub("n_tup_ins")} AS n_tup_ins, {sub("n_tup_upd")} AS n_tup_upd, {sub("n_tup_del")} AS n_tup_del,
       {_UPD} AS n_tup_total, {pct(sub("n_tup_hot_upd"), sub("n_tup_upd"))} AS hot_upd_rate FROM {tables()}"""
add("heavily_updated_tables", lambda r: relations.heavily_updated_tables(r, B, E), _UPDQ)
add(
    "heavily_updated_tables_top20",
    lambda r: relations.heavily_updated_tables(r, B, E, limit=relations.TOP_UPDATED),
    _UPDQ + " ORDER BY n_tup_total DESC, n_tup_ins DESC, n_tup_upd DESC, n_tup_del DESC, datname, nspname, relname LIMIT 20",
)
_AREAS = ("heap", "idx", "toast", "tidx")
_HITS = " + ".join(sub(f"{a}_blks_hit") for a in _AREAS)
_READ = " + ".join(sub(f"{a}_blks_read") for a in _AREAS)
_ACC = f"""
SELECT {NAMES}, {sub("seq_scan")} AS seq_scan, {sub("seq_tup_read")} AS seq_tup_read,
       {div(sub("seq_tup_read"), sub("seq_scan"))} AS tup_per_seq, {pct(_HITS, f"{_HITS} + {_READ}")} AS blks_hit_rate
FROM {tables(USER)} WHERE {sub("seq_tup_read")} > 0"""
add("heavily_accessed_tables", lambda r: relations.heavily_accessed_tables(r, B, E), _ACC)
add(
    "heavily_accessed_tables_top20",
    lambda r: relations.heavily_accessed_tables(r, B, E, limit=relations.TOP_ACCESSED),
    _ACC + " ORDER BY tup_per_seq DESC, datname, nspname, relname LIMIT 20",
)
_FILL = "COALESCE(CAST(NULLIF(regexp_extract(array_to_string(t.reloptions, '/'), 'fillfactor=([0-9]+)', 1), '') AS BIGINT), 100)"
add(
    "low_density_tables",
    lambda r: relations.low_density_tables(r, B, E),
    f"""
WITH v AS (SELECT t.*, d.name AS datname, s.name AS nspname FROM "table" t
             JOIN database d ON d.snapid = t.snapid AND d.dbid = t.dbid
             JOIN schema s ON s.snapid = t.snapid AND s.dbid = t.dbid AND s.nsp = t.nsp WHERE t.snapid = {E}),
     w AS (SELECT dbid, tbl, ((CAST(SUM(avg_width) AS BIGINT) + 7) // 8) * 8 AS width FROM "column"
           WHERE snapid = {E} AND attnum > 0 GROUP BY dbid, tbl),
     x AS (SELECT t.datname, t.nspname, t.name AS relname, t.n_live_tup,
                  {div3(f"(8192 - 24) * {_FILL}", "100 * (w.width + 24 + 4)")} // 1000 AS per_page,
                  {div3("t.size + CASE WHEN t.toastrelid = 0 THEN 0 ELSE o.size END", "8192")} AS pages3
           FROM v t LEFT JOIN w ON w.dbid = t.dbid AND w.tbl = t.tbl LEFT JOIN v o ON o.dbid = t.dbid AND o.tbl = t.toastrelid
           WHERE t.relkind = 'r' AND t.nspname NOT IN ('pg_catalog', 'information_schema', 'tidemark')),
     y AS (SELECT *, CAST(({div3("n_live_tup", "per_page")} + 999) // 1000 AS BIGINT) AS logical_pages FROM x WHERE pages3 > 1000000)
SELECT datname, nspname, relname, n_live_tup, logical_pages, {big(units("pages3", "1000", 0))} AS physical_pages,
       {ratio("logical_pages * 100000", "pages3", 1)} AS tratio FROM y""",
)
add(
    "correlation",
    lambda r: relations.correlation(r, B, E),
    f"""
SELECT d.name AS datname, s.name AS nspname, t.name AS relname, c.name AS attname, round(CAST(c.correlation AS DOUBLE), 3) AS correlation
FROM "index" i JOIN "table" t ON t.snapid = i.snapid AND t.dbid = i.dbid AND t.tbl = i.tbl
     JOIN schema s ON s.snapid = t.snapid AND s.dbid = t.dbid AND s.nsp = t.nsp
     JOIN database d ON d.snapid = i.snapid AND d.dbid = i.dbid
     JOIN "column" c ON c.snapid = i.snapid AND c.dbid = i.dbid AND c.tbl = i.tbl
WHERE i.snapid = {E} AND list_contains(i.indkey, c.attnum) AND s.name NOT IN ({USER}) AND c.correlation < 1""",
)
add(
    "schema_info_tables",
    lambda r: relations.schema_info_tables(r, B, E),
    f"""
SELECT {NAMES}, c.n AS attnum, e.n_live_tup AS tuples, {mib("e.size")} AS size, {mib(sub("size"))} AS size_incr,
       {sub("seq_scan")} AS seq_scan, {sub("idx_scan")} AS idx_scan
FROM {tables(USER)} LEFT JOIN (SELECT dbid, tbl, COUNT(*) AS n FROM "column" WHERE snapid = {E} GROUP BY dbid, tbl) c
     ON c.dbid = e.dbid AND c.tbl = e.tbl""",
)
add(
    "schema_info_indexes",
    lambda r: relations.schema_info_indexes(r, B, E),
    f"""
SELECT d.name AS datname, s.name AS schemaname, e.name AS indexname, t.name AS tablename, {mib("e.size")} AS size,
       {mib(sub("size"))} AS size_incr, {sub("idx_scan")} AS scans, {div(sub("idx_tup_fetch"), sub("idx_scan"))} AS rows_per_scan,
       {sub("idx_blks_read")} AS blks_read, {sub("idx_blks_hit")} AS blks_hit,
       regexp_extract(e.indexdef, '.*USING[^\\(]+\\((.*)\\)', 1) AS keys
FROM (SELECT * FROM "index" WHERE snapid = {E}) e
     LEFT JOIN (SELECT * FROM "index" WHERE snapid = {B}) b ON b.idx = e.idx AND b.tbl = e.tbl AND b.dbid = e.dbid
     JOIN "table" t ON t.snapid = e.snapid AND t.dbid = e.dbid AND t.tbl = e.tbl
     JOIN schema s ON s.snapid = t.snapid AND s.dbid = t.dbid AND s.nsp = t.nsp
     JOIN database d ON d.snapid = e.snapid AND d.dbid = e.dbid
WHERE s.name NOT IN ({USER}) AND regexp_matches(e.indexdef, 'USING[^\\(]+\\(.*\\)')""",
)
add(
    "setting_parameters",
    lambda r: relations.setting_parameters(r, B, E),
    f"""
SELECT name, CASE WHEN b.setting = e.setting THEN b.setting
                  ELSE COALESCE(b.setting, '(default)') || ' -> ' || COALESCE(e.setting, '(default)') END AS setting,
       COALESCE(e.unit, b.unit) AS unit, COALESCE(e.source, b.source) AS source
FROM (SELECT * FROM setting WHERE snapid = {B}) b FULL JOIN (SELECT * FROM setting WHERE snapid = {E}) e USING (name)""",
)
add(
    "modified_row_ratio",
    lambda r: relations.modified_row_ratio(r, B, E, 25),
    f"""
WITH v AS (SELECT t.*, o.time FROM "table" t JOIN o_scope o USING (snapid)),
     k AS (SELECT dbid, nsp, tbl FROM v GROUP BY dbid, nsp, tbl ORDER BY MAX(reltuples) DESC, dbid, nsp, tbl LIMIT 25)
SELECT {mins("v.time")} AS "timestamp", d.name AS datname, s.name AS nspname, v.name AS relname,
       CAST(MAX({div3("v.n_mod_since_analyze", "CAST(v.reltuples AS BIGINT)")}) AS DOUBLE) / 10 AS ratio
FROM v JOIN k USING (dbid, nsp, tbl) JOIN database d ON d.snapid = v.snapid AND d.dbid = v.dbid
     JOIN schema s ON s.snapid = v.snapid AND s.dbid = v.dbid AND s.nsp = v.nsp
GROUP BY ALL""",
)

# --- events ------------------------------------------------------------------
WINDOW = f"""BETWEEN (SELECT MIN(time) FROM snapshot WHERE instid = 1 AND snapid >= {B})
       AND (SELECT MAX(time) FROM snapshot WHERE instid = 1 AND snapid <= {E})"""


def events(table: str, at: str) -> str:
    return f"(SELECT * FROM {table} WHERE instid = 1 AND {at} {WINDOW})"


RUNS = events("autovacuum", '"start"')
NAMED = 'database AS datname, schema AS nspname, "table" AS relname'


def avg_eighths(c: str, scale: int = 3) -> str:
    """Average of a double that is a multiple of 1/16."""
    return f"(CASE WHEN COUNT({c}) > 0 THEN {ratio(f'CAST(SUM({c} * 16) AS BIGINT)', f'(16 * COUNT({c}))', scale)} END)"


add(
    "checkpoint_activity",
    lambda r: maintenance.checkpoint_activity(r, B, E),
    f"""
SELECT COUNT(*) AS ckpt_total, COUNT(*) FILTER (flags LIKE '%time%') AS ckpt_time, COUNT(*) FILTER (flags LIKE '%wal%') AS ckpt_wal,
       {avg3("num_buffers")} AS avg_write_buff, CAST(MAX(num_buffers) AS DOUBLE) AS max_write_buff,
       {avg_eighths("total_duration")} AS avg_duration, CAST(MAX(total_duration) AS DOUBLE) AS max_duration
FROM {events("checkpoint", '"start"')}""",
)


def _z(x: str) -> str:
    return f"COALESCE({x}, 0.0)"


_P2, _P4 = "CASE WHEN index_scan_ptn = 2 THEN {0} END", "CASE WHEN index_scan_ptn = 4 THEN {0} END"
add(
    "autovacuum_activity",
    lambda r: maintenance.autovacuum_activity(r, B, E),
    f"""
WITH v AS (
  SELECT database, schema, "table", COUNT(*) AS "count", COUNT(*) FILTER (index_scan_ptn = 2) AS index_scanned,
         COUNT(*) FILTER (index_scan_ptn = 4) AS index_skipped,
         {", ".join(f"{avg3(c, 1)} AS avg_{c}" for c in ("tup_removed", "tup_remain", "tup_dead", "tup_miss_dead", "tup_miss_dead_pages"))},
         {avg3("tbl_scan_pages", 1)} AS tbl_scan_pages, {avg_eighths("tbl_scan_pages_ratio", 1)} AS tbl_scan_pages_ratio,
         {avg3(_P2.format("dead_lp_pages"), 1)} AS dead_lp_pages, {avg_eighths(_P2.format("dead_lp_pages_ratio"), 1)} AS dead_lp_pages_ratio,
         {avg3(_P2.format("dead_lp"), 1)} AS removed_lp, {avg3(_P4.format("dead_lp"), 1)} AS dead_lp,
         CAST(SUM(index_scans) AS DOUBLE) AS sum_index_scans, {avg_eighths("duration", 1)} AS avg_duration,
         {ratio("CAST(MAX(duration) * 4 AS BIGINT)", "4", 1)} AS max_duration, {big("MAX(removable_cutoff)")} AS max_cutoff_xid,
         {big("MAX(new_relfrozenxid)")} AS max_frozen_xid, {big("MAX(new_relminmxid)")} AS max_relmin_mxid
  FROM {RUNS} GROUP BY database, schema, "table"),
c AS (SELECT database, schema, "table", COUNT(*) AS cancel FROM {events("autovacuum_cancel", '"timestamp"')} GROUP BY database, schema, "table")
SELECT {NAMED}, COALESCE("count", 0) AS "count", COALESCE(index_scanned, 0) AS index_scanned, COALESCE(index_skipped, 0) AS index_skipped,
       {", ".join(f"{_z(c)} AS {c}" for c in ("avg_tup_removed", "avg_tup_remain", "avg_tup_dead", "avg_tup_miss_dead", "avg_tup_miss_dead_pages", "tbl_scan_pages", "tbl_scan_pages_ratio", "dead_lp_pages", "dead_lp_pages_ratio", "removed_lp", "dead_lp", "sum_index_scans", "avg_duration", "max_duration"))},
       COALESCE(cancel, 0) AS cancel, max_cutoff_xid, max_frozen_xid, max_relmin_mxid
FROM v FULL JOIN c USING (database, schema, "table")""",
)


def _buffers(source: str) -> str:
    return f"""
SELECT {NAMED}, {", ".join(f"{avg3(f'page_{k}')} AS avg_page_{k}" for k in ("hit", "miss", "dirty"))},
       {", ".join(f"{avg_eighths(f'{k}_rate')} AS avg_{k}_rate" for k in ("read", "write"))},
       {", ".join(f"{avg_eighths(f'COALESCE(io_timings_{k}, 0)')} AS avg_{k}_duration" for k in ("read", "write"))}
FROM {source} GROUP BY database, schema, "table\""""


add("autovacuum_activity2", lambda r: maintenance.autovacuum_activity2(r, B, E), _buffers(RUNS))
add(
    "autoanalyze_activity2",
    lambda r: maintenance.autoanalyze_activity2(r, B, E),
    _buffers(events("autoanalyze", '"start"')),
)
add(
    "autovacuum_wal_activity",
    lambda r: maintenance.autovacuum_wal_activity(r, B, E),
    f"""
SELECT {NAMED}, COUNT(*) AS "count", {avg3("wal_records")} AS wal_records, {avg3("wal_page_images")} AS wal_fpis,
       {avg3("wal_bytes")} AS wal_bytes FROM {RUNS} GROUP BY database, schema, "table\"""",
)
add(
    "autovacuum_wal_tendency",
    lambda r: maintenance.autovacuum_wal_tendency(r, B, E),
    f"""
WITH i AS (SELECT snapid, time AS t2, LAG(time) OVER (ORDER BY snapid) AS t1 FROM o_scope)
SELECT snapid, {mins("t2")} AS "timestamp", {big("SUM(wal_page_images)")} AS wal_fpi, {big("SUM(wal_bytes)")} AS wal_bytes
FROM i JOIN (SELECT * FROM autovacuum WHERE instid = 1) a ON a."start" BETWEEN t1 AND t2 GROUP BY snapid, t2""",
)
add(
    "autovacuum_index_activity",
    lambda r: maintenance.autovacuum_index_activity(r, B, E),
    f"""
WITH u AS (SELECT database, schema, "table", unnest(index_names) AS index_name, unnest(index_pages_total) AS a,
                  unnest(index_pages_new_del) AS n, unnest(index_pages_current_del) AS c, unnest(index_pages_reusable) AS r FROM {RUNS})
SELECT {NAMED}, index_name, COUNT(*) AS "count", {avg3("a")} AS page_total, {avg3("n")} AS page_new_del, {avg3("c")} AS page_cur_del,
       {avg3("r")} AS page_reuse FROM u GROUP BY database, schema, "table", index_name""",
)
add(
    "autoanalyze_stats",
    lambda r: maintenance.autoanalyze_stats(r, B, E),
    f"""
WITH a AS (SELECT database, schema, "table", {ratio("CAST(SUM(CAST(duration AS DOUBLE) * 4) AS BIGINT)", "4")} AS total_duration,
                  {avg_eighths("duration")} AS avg_duration, CAST(MAX(duration) AS DOUBLE) AS max_duration, COUNT(*) AS "count",
                  MAX("start") AS last FROM {events("autoanalyze", '"start"')} GROUP BY database, schema, "table"),
     c AS (SELECT database, schema, "table", COUNT(*) AS cancels FROM {events("autoanalyze_cancel", '"timestamp"')} GROUP BY database, schema, "table"),
     m AS (SELECT d.name AS database, s.name AS schema, t.name AS "table", MAX(t.n_mod_since_analyze) AS mod_rows_max
           FROM "table" t JOIN o_scope USING (snapid) JOIN database d ON d.snapid = t.snapid AND d.dbid = t.dbid
                JOIN schema s ON s.snapid = t.snapid AND s.dbid = t.dbid AND s.nsp = t.nsp GROUP BY ALL)
SELECT {NAMED}, {_z("total_duration")} AS total_duration, {_z("avg_duration")} AS avg_duration, {_z("max_duration")} AS max_duration,
       COALESCE("count", 0) AS "count", {sec("last")} AS last_analyze, COALESCE(cancels, 0) AS cancels, mod_rows_max
FROM a FULL JOIN c USING (database, schema, "table") LEFT JOIN m USING (database, schema, "table")""",
)
_LX = f"""
SELECT {big("pid")} AS pid, client, {sec('"start"')} AS "start", {ratio("CAST(MAX(duration * 64) AS BIGINT)", "64")} AS duration,
       arg_max(query, snapid) AS query
FROM xact JOIN o_scope USING (snapid) WHERE pid <> 0 GROUP BY pid, client, xact."start\""""
add("long_transactions", lambda r: maintenance.long_transactions(r, B, E), _LX)
add(
    "long_transactions_top10",
    lambda r: maintenance.long_transactions(r, B, E, limit=10),
    _LX + " ORDER BY 4 DESC, 1, 3 LIMIT 10",
)
add(
    "lock_activity",
    lambda r: maintenance.lock_activity(r, B, E),
    f"""
WITH l AS (SELECT lock.*, COALESCE(nspname, '') AS kn, COALESCE(blocker_gid, '') AS kg FROM lock JOIN o_scope USING (snapid) WHERE snapid > {B}),
     r AS (SELECT *, RANK() OVER (PARTITION BY dbid, kn, relname, blockee_pid, blocker_pid, kg, blockee_query ORDER BY snapid DESC) AS k FROM l)
SELECT t.dn AS datname, t.sn AS nspname, COALESCE(t.tn, 'OID:[' || r.relname || ']') AS relname, r.duration,
       {big("r.blockee_pid")} AS blockee_pid, {big("r.blocker_pid")} AS blocker_pid, r.blocker_gid, r.blockee_query, r.blocker_query
FROM r LEFT JOIN (SELECT t.snapid, t.dbid, t.tbl, t.name AS tn, d.name AS dn, s.name AS sn
                  FROM "table" t JOIN database d ON d.snapid = t.snapid AND d.dbid = t.dbid
                       JOIN schema s ON s.snapid = t.snapid AND s.dbid = t.dbid AND s.nsp = t.nsp) t
     ON t.snapid = r.snapid AND t.dbid = r.dbid AND t.tbl = CAST(r.relname AS BIGINT)
WHERE k = 1""",
)
add(
    "alert_list",
    lambda r: maintenance.alert_list(r, B, E),
    f'SELECT {sec("time")} AS "timestamp", message FROM alert_message JOIN o_scope USING (snapid)',
)
add(
    "profiles",
    lambda r: maintenance.profiles(r, B, E),
    f"SELECT processing, {big('SUM(execute)')} AS executes FROM profile JOIN o_scope USING (snapid) GROUP BY processing",
)

# --- statements --------------------------------------------------------------
_TIMES = [f"{a}_blk_{o}_time" for a in ("shared", "local", "temp") for o in ("read", "write")]


def per(total: str, n: str) -> str:
    """total / n for a total that is a multiple of 1/16."""
    return f"(CASE WHEN {n} = 0 THEN 0.0 ELSE {ratio(f'CAST({total} * 16 AS BIGINT)', f'(16 * {n})')} END)"


def r3(x: str) -> str:
    return ratio(f"CAST(({x}) * 16 AS BIGINT)", "16")


_FN = f"""
SELECT e.funcid, d.name AS datname, s.name AS nspname, e.funcname AS proname, {sub("calls")} AS calls,
       {r3(sub("total_time"))} AS total_time, {r3(sub("self_time"))} AS self_time,
       CASE WHEN {sub("total_time")} = 0 OR {sub("calls")} <= 0 THEN 0.0 ELSE {ratio(f"CAST({sub('total_time')} * 16 AS BIGINT)", f"(16 * {sub('calls')})")} END AS time_per_call
FROM (SELECT * FROM function WHERE snapid = {E}) e
     LEFT JOIN (SELECT * FROM function WHERE snapid = {B}) b ON b.dbid = e.dbid AND b.nsp = e.nsp AND b.funcid = e.funcid
     JOIN database d ON d.snapid = e.snapid AND d.dbid = e.dbid
     JOIN schema s ON s.snapid = e.snapid AND s.dbid = e.dbid AND s.nsp = e.nsp"""
add("query_functions", lambda r: statements.query_functions(r, B, E), _FN)
add(
    "query_functions_top20",
    lambda r: statements.query_functions(r, B, E, limit=20),
    _FN + " ORDER BY total_time DESC, self_time DESC, calls DESC, funcid, datname LIMIT 20",
)


def _registry(table: str, keys: str) -> str:
    on_b = " AND ".join(f"b.{k} = g.{k}" for k in keys.split(", "))
    on_e = on_b.replace("b.", "e.")
    return f"""
g AS (SELECT {keys}, MAX(snapid) AS last FROM {table} JOIN o_scope USING (snapid) GROUP BY {keys}),
p AS (SELECT g.last, e.*, {", ".join(f"b.{c} AS b_{c}" for c in (["plans", "total_plan_time"] if table == "statement" else []) + ["calls", "total_exec_time" if table == "statement" else "total_time"] + _TIMES)}
      FROM g JOIN {table} e ON e.snapid = g.last AND {on_e} LEFT JOIN {table} b ON b.snapid = {B} AND {on_b})"""


def psub(c: str) -> str:
    return f"(COALESCE({c}, 0) - COALESCE(b_{c}, 0))"


_STMT_CTE = "WITH " + _registry("statement", "dbid, userid, queryid") + f""",
q AS (SELECT r.name AS rolname, d.name AS datname, query, {psub("plans")} AS plans, {r3(psub("total_plan_time"))} AS total_plan_time,
       {per(psub("total_plan_time"), psub("plans"))} AS time_per_plan, {psub("calls")} AS calls, {r3(psub("total_exec_time"))} AS total_exec_time,
       {per(psub("total_exec_time"), psub("calls"))} AS time_per_call,
       {", ".join(f"{r3(psub(c))} AS {c.replace('temp_', 'tmp_')}" for c in _TIMES)}, p.dbid, p.userid, p.queryid, p.last
FROM p JOIN database d ON d.snapid = {B} AND d.dbid = p.dbid JOIN role r ON r.snapid = {B} AND r.userid = p.userid
WHERE {psub("calls")} > 0 AND {psub("total_exec_time")} > 0)"""
_TOPQ = " ORDER BY total_exec_time DESC, calls DESC, dbid, userid, queryid LIMIT 20"
add("query_statements", lambda r: statements.query_statements(r, B, E), _STMT_CTE + " SELECT * FROM q")
add("query_statements_top20", lambda r: statements.query_statements(r, B, E, limit=20), _STMT_CTE + " SELECT * FROM q" + _TOPQ)


def _usage(c: str) -> str:
    value = f"(COALESCE(e.{c}, 0) - COALESCE(b.{c}, 0))"
    if c.endswith("time"):
        return f"{value} AS {c.replace('_system_time', '_sys_times').replace('_user_time', '_user_times')}"
    return f"{value} AS {c}"


add(
    "query_statements_rusage",
    lambda r: statements.query_statements_rusage(r, B, E),
    _STMT_CTE
    + f"""
SELECT rolname, datname, query, {", ".join(_usage(f"{k}_{u}") for k in ("plan", "exec") for u in ("reads", "writes", "user_time", "system_time"))}
FROM q JOIN rusage e ON e.snapid = q.last AND e.dbid = q.dbid AND e.userid = q.userid AND e.queryid = q.queryid
     LEFT JOIN rusage b ON b.snapid = {B} AND b.dbid = q.dbid AND b.userid = q.userid AND b.queryid = q.queryid""",
)
_PLAN_FIG = f"""{psub("calls")} AS calls, {r3(psub("total_time"))} AS total_time, {per(psub("total_time"), psub("calls"))} AS time_per_call,
       {", ".join(f"{r3(psub(c))} AS {c}" for c in _TIMES)}"""
_PLAN_CTE = "WITH " + _registry("plan", "queryid, planid, dbid, userid")
_PLAN_KEEP = f"WHERE {psub('calls')} > 0 AND {psub('total_time')} > 0"
_PLANS = f"""{_PLAN_CTE}
SELECT p.queryid, p.planid, r.name AS rolname, d.name AS datname, {_PLAN_FIG}
FROM p JOIN database d ON d.snapid = {B} AND d.dbid = p.dbid JOIN role r ON r.snapid = {B} AND r.userid = p.userid {_PLAN_KEEP}"""
add("query_plans", lambda r: statements.query_plans(r, B, E), _PLANS)
add(
    "query_plans_top20",
    lambda r: statements.query_plans(r, B, E, limit=20),
    _PLANS + " ORDER BY total_time DESC, calls DESC, queryid, planid, datname, rolname LIMIT 20",
)
add(
    "query_plans_report",
    lambda r: statements.query_plans_report(r, B, E),
    f"""{_PLAN_CTE},
x AS (SELECT queryid, dbid, userid, MAX(query) AS query FROM statement JOIN o_scope USING (snapid) GROUP BY queryid, dbid, userid)
SELECT p.queryid, p.planid, r.name AS rolname, d.name AS datname, {_PLAN_FIG}, {sec("p.first_call")} AS first_call,
       {sec("p.last_call")} AS last_call, x.query, p.last AS snapid, p.dbid, p.userid
FROM p JOIN database d ON d.snapid = p.last AND d.dbid = p.dbid JOIN role r ON r.snapid = p.last AND r.userid = p.userid
     JOIN x ON x.queryid = p.queryid AND x.dbid = p.dbid AND x.userid = p.userid {_PLAN_KEEP}""",
)

# --- waits -------------------------------------------------------------------
_W = f"""
SELECT e.dbid, e.userid, e.queryid, e.backend_type, e.event_type, e.event, {sub("count")} AS c
FROM (SELECT * FROM wait_sampling WHERE snapid = {E}) e LEFT JOIN (SELECT * FROM wait_sampling WHERE snapid = {B}) b
     USING (dbid, userid, queryid, backend_type, event_type, event) WHERE {sub("count")} > 0"""


def _ranked(part: str) -> str:
    over = f"PARTITION BY {part}" if part else ""
    return f"""*, {ratio("c * 100", f"SUM(c) OVER ({over})")} AS ratio,
       ROW_NUMBER() OVER ({over} ORDER BY c DESC, event_type, event) AS row_number"""


add(
    "wait_sampling",
    lambda r: waits.wait_sampling(r, B, E),
    _STMT_CTE
    + f""",
s AS (SELECT * FROM q{_TOPQ}), w AS ({_W}), k AS (SELECT {_ranked("queryid, dbid, userid, backend_type")} FROM w)
SELECT k.queryid, k.dbid, k.userid, s.datname AS database, s.rolname AS role, backend_type, event_type, event, c AS "count", ratio, s.query, row_number
FROM k JOIN s USING (dbid, userid, queryid) WHERE row_number <= 10""",
)
add(
    "wait_sampling_by_instance",
    lambda r: waits.wait_sampling_by_instance(r, B, E),
    f"""
WITH w AS ({_W}), g AS (SELECT event_type, event, CAST(SUM(c) AS BIGINT) AS c FROM w GROUP BY event_type, event), k AS (SELECT {_ranked("")} FROM g)
SELECT event_type, event, c AS "count", ratio, row_number FROM k WHERE row_number <= 10""",
)
add(
    "wait_sampling_by_database",
    lambda r: waits.wait_sampling_by_database(r, B, E),
    f"""
WITH w AS ({_W}), g AS (SELECT dbid, event_type, event, CAST(SUM(c) AS BIGINT) AS c FROM w GROUP BY dbid, event_type, event), k AS (SELECT {_ranked("dbid")} FROM g)
SELECT k.dbid, COALESCE(d.name, '<global>') AS database, event_type, event, c AS "count", ratio, row_number
FROM k LEFT JOIN (SELECT dbid, name FROM database WHERE snapid = {B}) d USING (dbid) WHERE row_number <= 10""",
)

# --- replication -------------------------------------------------------------
_SLOT = replication.SLOT_COUNTERS
add(
    "replication_slots_report",
    lambda r: replication.replication_slots_report(r, B, E),
    f"""
SELECT e.slot_name, s.slot_type, d.name AS slot_datname,
       {", ".join(f"CASE WHEN e.stats_reset IS NULL THEN e.{c} - COALESCE(b.{c}, 0) WHEN e.stats_reset = b.stats_reset THEN e.{c} - b.{c} ELSE e.{c} END AS {c}" for c in _SLOT)},
       {full("e.stats_reset")} AS stats_reset
FROM (SELECT * FROM stat_replication_slots WHERE snapid = {E}) e
     LEFT JOIN (SELECT * FROM stat_replication_slots WHERE snapid = {B}) b USING (slot_name)
     LEFT JOIN (SELECT * FROM replication_slots WHERE snapid = {E}) s USING (slot_name)
     LEFT JOIN (SELECT * FROM database WHERE snapid = {E}) d ON d.dbid = s.datoid""",
)
_DEL = f"""
WITH y AS (SELECT r.*, o.time, {lsn("current_location")} - {lsn("flush_location")} AS fd, {lsn("current_location")} - {lsn("replay_location")} AS rd
           FROM replication r JOIN o_scope o USING (snapid) LEFT JOIN replication_slots s ON s.snapid = r.snapid AND s.active_pid = r.procpid
           WHERE flush_location IS NOT NULL AND replay_location IS NOT NULL AND (s.slot_name IS NULL OR s.slot_type = 'physical'))"""
add(
    "replication_delays",
    lambda r: replication.replication_delays(r, B, E),
    _DEL
    + f""" SELECT snapid, {mins("time")} AS "timestamp", client_addr, application_name,
       COALESCE(split_part(client_addr, '/', 1), 'local') || ':' || CASE WHEN application_name = '' THEN '(none)' ELSE application_name END AS client,
       CAST(fd AS DOUBLE) AS flush_delay_size, CAST(rd AS DOUBLE) AS replay_delay_size, sync_state FROM y""",
)
_ACT = _DEL + f""",
a AS (SELECT client_addr, application_name, MAX(snapid) AS snapid, {ratio("SUM(rd)", "COUNT(rd)", 6)} AS av, MAX(rd) AS pk,
             {units("SUM(rd)", "COUNT(rd)", 0)} AS av0 FROM y GROUP BY client_addr, application_name),
j AS (SELECT a.av, a.pk, a.av0, r.*, o.time FROM a JOIN replication r ON r.snapid = a.snapid AND r.client_addr IS NOT DISTINCT FROM a.client_addr
             AND r.application_name = a.application_name JOIN o_scope o ON o.snapid = a.snapid)"""
_SH = f"""usename, application_name, client_addr, client_hostname, {big("client_port")} AS client_port, {sec("backend_start")} AS backend_start, state,
       current_location, sent_location, write_location, flush_location, replay_location, {big("sync_priority")} AS sync_priority, sync_state"""
add(
    "replication_activity",
    lambda r: replication.replication_activity(r, B, E),
    _ACT
    + f""" SELECT {sec("time")} AS snapshot_time, {_SH}, av AS replay_delay_avg, CAST(pk AS DOUBLE) AS replay_delay_peak, write_lag AS write_lag_time,
       flush_lag AS flush_lag_time, replay_lag AS replay_lag_time, {big("NULLIF(sync_priority, 0)")} AS priority_sortkey FROM j""",
)


def _label(u: str) -> str:
    def two(x: str) -> str:
        return f"lpad(CAST({x} AS VARCHAR), 2, '0')"

    return f"{two(f'{u} // 3600000000')} || ':' || {two(f'({u} // 60000000) % 60')} || ':' || {two(f'({u} // 1000000) % 60')} || '.' || lpad(CAST({u} % 1000000 AS VARCHAR), 6, '0')"


add(
    "replication_status",
    lambda r: replication.replication_status(r, B, E),
    _ACT
    + f""" SELECT {_SH}, {size_text("CAST(av0 AS BIGINT)")} AS replay_delay_avg, {size_text("CAST(pk AS BIGINT)")} AS replay_delay_peak,
       {", ".join(f"{_label(f'{k}_lag')} AS {k}_lag_time" for k in ("write", "flush", "replay"))} FROM j""",
)

# --- hardware ----------------------------------------------------------------


def _in_force(table: str) -> str:
    return f"""(SELECT * FROM {table} WHERE instid = 1 AND "timestamp" <= (SELECT MAX(time) FROM o_scope)
  AND "timestamp" >= COALESCE((SELECT MAX("timestamp") FROM {table} WHERE instid = 1 AND "timestamp" <= (SELECT MIN(time) FROM o_scope)), TIMESTAMP '1997-01-29'))"""


add(
    "cpuinfo",
    lambda r: hardware.cpuinfo(r, B, E),
    f"""SELECT {mins('"timestamp"')} AS "timestamp", vendor_id, model_name, CAST(cpu_mhz AS DOUBLE) AS cpu_mhz,
       {", ".join(f"{big(c)} AS {c}" for c in ("processors", "threads_per_core", "cores_per_socket", "sockets"))} FROM {_in_force("cpuinfo")}""",
)
_SYS = size_text("mem_total").replace("KiB", "kB").replace("MiB", "MB").replace("GiB", "GB").replace("TiB", "TB")
add(
    "meminfo",
    lambda r: hardware.meminfo(r, B, E),
    f"""SELECT {mins('"timestamp"')} AS "timestamp", {_SYS} AS mem_total FROM {_in_force("meminfo")}""",
)

# --- remaining limits and scans ----------------------------------------------
add(
    "scan_fact",
    lambda r: r.between("table", B, E).select("snapid", "dbid", "tbl", "size"),
    f"""SELECT snapid, dbid, tbl, size FROM "table" WHERE snapid BETWEEN {B} AND {E}""",
)
add(
    "scan_events",
    lambda r: r.events("checkpoint", B, E).select("start", "num_buffers"),
    f"""SELECT {full('"start"')} AS "start", num_buffers FROM {events("checkpoint", '"start"')}""",
)
add(
    "query_statements_rusage_top20",
    lambda r: statements.query_statements_rusage(r, B, E, limit=20),
    _STMT_CTE
    + f""", z AS (SELECT * FROM q JOIN (SELECT DISTINCT snapid AS last, dbid, userid, queryid FROM rusage) k USING (last, dbid, userid, queryid){_TOPQ})
SELECT rolname, datname, query, {", ".join(_usage(f"{k}_{u}") for k in ("plan", "exec") for u in ("reads", "writes", "user_time", "system_time"))}
FROM z JOIN rusage e ON e.snapid = z.last AND e.dbid = z.dbid AND e.userid = z.userid AND e.queryid = z.queryid
     LEFT JOIN rusage b ON b.snapid = {B} AND b.dbid = z.dbid AND b.userid = z.userid AND b.queryid = z.queryid""",
)
add(
    "query_statements_named_at_last",
    lambda r: statements.query_statements(r, B, E, names_as_of="last").select("dbid", "userid", "queryid", "rolname", "datname", "calls", "last"),
    "WITH " + _registry("statement", "dbid, userid, queryid") + f"""
SELECT p.dbid, p.userid, p.queryid, r.name AS rolname, d.name AS datname, {psub("calls")} AS calls, p.last
FROM p JOIN database d ON d.snapid = p.last AND d.dbid = p.dbid JOIN role r ON r.snapid = p.last AND r.userid = p.userid
WHERE {psub("calls")} > 0 AND {psub("total_exec_time")} > 0""",
)
