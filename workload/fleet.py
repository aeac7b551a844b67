"""Reports of all servers in one job, beside SQL over every scope."""

from __future__ import annotations

from tidemark.plans import catalogue
from workload.oracle import mib, pct, sub, tps
from workload.registry import add
from workload.reports_a import READS
from workload.reports_b import _TIMES, NAMES, USER, per, psub, r3
from workload.stored import _stored

SCOPES = "sc AS (SELECT instid, MIN(snapid) AS first, MAX(snapid) AS final FROM snapshot GROUP BY instid HAVING MIN(snapid) <> MAX(snapid))"


def _fleet(r, name: str):
    return catalogue.fleet_reports(r, catalogue.report_scope_by_snapid(r))[name]


_SPAN = "(epoch_us(te.time) - epoch_us(tb.time))"
_STATS = f"""
WITH {SCOPES}
SELECT sc.instid, e.name AS datname, {mib("e.size")} AS size, {mib(sub("size"))} AS size_incr,
       {tps(sub("xact_commit"), _SPAN)} AS xact_commit_tps, {tps(sub("xact_rollback"), _SPAN)} AS xact_rollback_tps,
       {pct(sub("blks_hit"), READS)} AS blks_hit_rate, {tps(READS, _SPAN)} AS blks_hit_tps,
       {tps(sub("blks_read"), _SPAN)} AS blks_read_tps, {tps(f"{sub('tup_returned')} + {sub('tup_fetched')}", _SPAN)} AS tup_fetch_tps,
       {sub("temp_files")} AS temp_files, {mib(sub("temp_bytes"))} AS temp_bytes, {sub("deadlocks")} AS deadlocks,
       {sub("blk_read_time")} AS blk_read_time, {sub("blk_write_time")} AS blk_write_time
FROM sc JOIN snapshot te ON te.snapid = sc.final JOIN snapshot tb ON tb.snapid = sc.first
     JOIN database e ON e.snapid = sc.final LEFT JOIN database b ON b.snapid = sc.first AND b.dbid = e.dbid"""
add("fleet_dbstats", lambda r: _fleet(r, "dbstats"), _STATS)
add("fleet_dbstats_stored", lambda r: _fleet(_stored(r, "database"), "dbstats"), _STATS)

_COUNTED = ["plans", "total_plan_time", "calls", "total_exec_time", *_TIMES]
add(
    "fleet_query_statements",
    lambda r: _fleet(r, "query_statements"),
    f"""
WITH {SCOPES},
g AS (SELECT sc.instid, dbid, userid, queryid, ANY_VALUE(sc.first) AS first, MAX(snapid) AS last
      FROM statement JOIN snapshot USING (snapid) JOIN sc ON sc.instid = snapshot.instid AND snapid BETWEEN sc.first AND sc.final
      GROUP BY sc.instid, dbid, userid, queryid),
p AS (SELECT g.instid, g.first, g.last, e.*, {", ".join(f"b.{c} AS b_{c}" for c in _COUNTED)}
      FROM g JOIN statement e ON e.snapid = g.last AND e.dbid = g.dbid AND e.userid = g.userid AND e.queryid = g.queryid
           LEFT JOIN statement b ON b.snapid = g.first AND b.dbid = g.dbid AND b.userid = g.userid AND b.queryid = g.queryid)
SELECT p.instid, r.name AS rolname, d.name AS datname, query, {psub("plans")} AS plans, {r3(psub("total_plan_time"))} AS total_plan_time,
       {per(psub("total_plan_time"), psub("plans"))} AS time_per_plan, {psub("calls")} AS calls, {r3(psub("total_exec_time"))} AS total_exec_time,
       {per(psub("total_exec_time"), psub("calls"))} AS time_per_call,
       {", ".join(f"{r3(psub(c))} AS {c.replace('temp_', 'tmp_')}" for c in _TIMES)}, p.dbid, p.userid, p.queryid, p.last
FROM p JOIN database d ON d.snapid = p.first AND d.dbid = p.dbid JOIN role r ON r.snapid = p.first AND r.userid = p.userid
WHERE {psub("calls")} > 0 AND {psub("total_exec_time")} > 0""",
)
add(
    "fleet_schema_info_tables",
    lambda r: _fleet(r, "schema_info_tables"),
    f"""
WITH {SCOPES},
e AS (SELECT sc.instid, sc.first, t.*, d.name AS datname, s.name AS nspname FROM sc JOIN "table" t ON t.snapid = sc.final
      JOIN database d ON d.snapid = t.snapid AND d.dbid = t.dbid
      JOIN schema s ON s.snapid = t.snapid AND s.dbid = t.dbid AND s.nsp = t.nsp WHERE s.name NOT IN ({USER}, 'tidemark')),
c AS (SELECT snapid, dbid, tbl, COUNT(*) AS n FROM "column" GROUP BY snapid, dbid, tbl)
SELECT e.instid, {NAMES}, c.n AS attnum, e.n_live_tup AS tuples, {mib("e.size")} AS size, {mib(sub("size"))} AS size_incr,
       {sub("seq_scan")} AS seq_scan, {sub("idx_scan")} AS idx_scan
FROM e LEFT JOIN "table" b ON b.snapid = e.first AND b.dbid = e.dbid AND b.nsp = e.nsp AND b.tbl = e.tbl
     LEFT JOIN c ON c.snapid = e.snapid AND c.dbid = e.dbid AND c.tbl = e.tbl""",
)
