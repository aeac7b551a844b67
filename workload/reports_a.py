"""Databases, instance activity and operating-system reports."""

from tidemark.plans import catalogue, databases, instance, resources
from workload.oracle import B, E, avg3, big, div3, mib, mins, pct, ratio, sec, size_text, sub, tps, units
from workload.registry import add

SINCE, UNTIL = "2024-01-04 00:00:00", "2024-01-20 12:00:00"
US = "(SELECT epoch_us(t2) - epoch_us(t1) FROM o_pair)"


def pair(table: str, keys: str) -> str:
    """FROM clause: rows at the end, rows at the begin beside them."""
    return (
        f'(SELECT * FROM "{table}" WHERE snapid = {E}) e LEFT JOIN (SELECT * FROM "{table}" WHERE snapid = {B}) b USING ({keys})'
    ).replace(f'FROM "{table}"', f"FROM {table}" if table not in ("table", "index", "column") else f'FROM "{table}"')


add(
    "min_snapid",
    lambda r: databases.min_snapid(r, "host1", 5432, SINCE, UNTIL),
    f"SELECT MIN(snapid) AS snapid FROM snapshot WHERE instid = 1 AND time BETWEEN '{SINCE}' AND '{UNTIL}'",
)
add(
    "max_snapid",
    lambda r: databases.max_snapid(r, "host2", "5433", SINCE, UNTIL),
    f"SELECT MAX(snapid) AS snapid FROM snapshot WHERE instid = 2 AND time BETWEEN '{SINCE}' AND '{UNTIL}'",
)
add(
    "min_snapid2",
    lambda r: databases.min_snapid2(r, 2, SINCE, UNTIL),
    f"SELECT MIN(snapid) AS snapid FROM snapshot WHERE instid = 2 AND time BETWEEN '{SINCE}' AND '{UNTIL}'",
)
add(
    "max_snapid2",
    lambda r: databases.max_snapid2(r, "1", SINCE, UNTIL),
    f"SELECT MAX(snapid) AS snapid FROM snapshot WHERE instid = 1 AND time BETWEEN '{SINCE}' AND '{UNTIL}'",
)
add(
    "summary",
    lambda r: databases.summary(r, B, E),
    f"""
WITH t AS (
  SELECT CAST(SUM(e.size) AS BIGINT) AS size, CAST(SUM(e.xact_commit - b.xact_commit) AS BIGINT) AS c,
         CAST(SUM(e.xact_rollback - b.xact_rollback) AS BIGINT) AS r
  FROM database e JOIN database b ON b.dbid = e.dbid WHERE e.snapid = {E} AND b.snapid = {B})
SELECT i.name AS instname, i.hostname, {big("i.port")} AS port, i.pg_version, {sec("p.t1")} AS snap_begin,
       {sec("p.t2")} AS snap_end, (epoch_us(p.t2) - epoch_us(p.t1) + 500000) // 1000000 AS duration,
       {size_text("t.size")} AS total_dbsize, t.c AS total_commits, t.r AS total_rollbacks
FROM instance i CROSS JOIN o_pair p CROSS JOIN t WHERE i.instid = 1""",
)
READS = f"{sub('blks_read')} + {sub('blks_hit')}"
add(
    "dbstats",
    lambda r: databases.dbstats(r, B, E),
    f"""
SELECT e.name AS datname, {mib("e.size")} AS size, {mib(sub("size"))} AS size_incr,
       {tps(sub("xact_commit"), US)} AS xact_commit_tps, {tps(sub("xact_rollback"), US)} AS xact_rollback_tps,
       {pct(sub("blks_hit"), READS)} AS blks_hit_rate, {tps(READS, US)} AS blks_hit_tps,
       {tps(sub("blks_read"), US)} AS blks_read_tps, {tps(f"{sub('tup_returned')} + {sub('tup_fetched')}", US)} AS tup_fetch_tps,
       {sub("temp_files")} AS temp_files, {mib(sub("temp_bytes"))} AS temp_bytes, {sub("deadlocks")} AS deadlocks,
       {sub("blk_read_time")} AS blk_read_time, {sub("blk_write_time")} AS blk_write_time
FROM {pair("database", "dbid")}""",
)
add(
    "xact_tendency",
    lambda r: databases.xact_tendency(r, B, E),
    f"""
WITH m AS (SELECT snapid, time, name, SUM(xact_commit) AS c, SUM(xact_rollback) AS r
           FROM database JOIN o_scope USING (snapid) GROUP BY ALL),
     d AS (SELECT snapid, time, name, c - LAG(c) OVER w AS c, r - LAG(r) OVER w AS r,
                  epoch_us(time) - epoch_us(LAG(time) OVER w) AS us
           FROM m WINDOW w AS (PARTITION BY name ORDER BY snapid))
SELECT {mins("time")} AS "timestamp", name AS datname,
       COALESCE({tps("CASE WHEN c > 0 THEN c ELSE 0 END", "us")}, 0.0) AS commit_tps,
       COALESCE({tps("CASE WHEN r > 0 THEN r ELSE 0 END", "us")}, 0.0) AS rollback_tps
FROM d WHERE snapid > {B}""",
)
add(
    "dbsize_tendency",
    lambda r: databases.dbsize_tendency(r, B, E),
    f"""
SELECT {mins("time")} AS "timestamp", name AS datname, {ratio("SUM(size)", "1048576")} AS size
FROM database JOIN o_scope USING (snapid) GROUP BY snapid, time, name""",
)


def _np(c: str) -> str:
    return f"SUM(CASE WHEN {c} < COALESCE(p_{c}, 0) THEN {c} ELSE {c} - COALESCE(p_{c}, 0) END)"


_RU = ["plan_reads", "plan_writes", "plan_user_time", "plan_system_time", "exec_reads", "exec_writes", "exec_user_time", "exec_system_time"]
add(
    "db_rusage",
    lambda r: databases.db_rusage(r, B, E),
    f"""
WITH l AS (SELECT u.*, {", ".join(f"LAG({c}) OVER w AS p_{c}" for c in _RU)}
           FROM rusage u JOIN o_scope USING (snapid)
           WINDOW w AS (PARTITION BY dbid, userid, queryid ORDER BY snapid))
SELECT d.name AS datname,
       {", ".join((f"CAST({_np(c)} AS BIGINT)" if not c.endswith("time") else _np(c)) + " AS " + c.replace("user_time", "utime").replace("system_time", "stime") for c in _RU)}
FROM l JOIN (SELECT dbid, name FROM database WHERE snapid = {E}) d USING (dbid)
WHERE l.snapid > {B} GROUP BY d.name""",
)
_CONF = [f"confl_{k}" for k in ("tablespace", "lock", "snapshot", "bufferpin", "deadlock")]
add(
    "recovery_conflicts",
    lambda r: databases.recovery_conflicts(r, B, E),
    f"SELECT e.name AS datname, {', '.join(f'{sub(c)} AS {c}' for c in _CONF)} FROM {pair('database', 'dbid')}",
)

# --- instance ----------------------------------------------------------------
_ST = instance.STATES
_ALL = "(idle + idle_in_xact + waiting + running)"
add(
    "proc_ratio",
    lambda r: instance.proc_ratio(r, B, E),
    f"""
SELECT {", ".join(f"CASE WHEN SUM({_ALL}) = 0 THEN 0.0 ELSE {ratio(f'100 * SUM({s})', f'SUM({_ALL})', 1)} END AS {s}" for s in _ST)}
FROM activity JOIN o_scope USING (snapid)""",
)


def _proc(text: str) -> str:
    """Rows of the process report as CTE ``p`` in front of ``text``."""
    return f"""
WITH t AS (SELECT snapid, time, (epoch_us(time) - epoch_us(LAG(time) OVER (ORDER BY snapid)) + 500000) // 1000000 AS lasted
           FROM snapshot WHERE instid = 1 AND snapid BETWEEN {B - 1} AND {E}),
     a AS (SELECT a.*, t.time, COALESCE(lasted, 600) // COALESCE(CAST(setting AS BIGINT), 5) AS k
           FROM activity a JOIN t USING (snapid)
                LEFT JOIN (SELECT snapid, setting FROM setting WHERE name LIKE '%.sampling_interval') USING (snapid)
           WHERE a.snapid BETWEEN {B} AND {E}),
     p AS (SELECT {mins("time")} AS ts, {", ".join(f"CAST(CASE WHEN k = 0 THEN {s} ELSE {s} // k END AS BIGINT) AS {s}, CASE WHEN {_ALL} = 0 THEN 0 ELSE {units(f'100 * {s}', _ALL, 1)} END AS {s}_tenths" for s in _ST)}
           FROM a)
{text}"""


add(
    "proc_tendency",
    lambda r: instance.proc_tendency(r, B, E),
    _proc(
        f'SELECT ts AS "timestamp", {", ".join(f"{s}, CAST({s}_tenths AS DOUBLE) / 10 AS {s}_per" for s in _ST)} FROM p'
    ),
)


def _tenths(u: str) -> str:
    return f"'(' || CAST(CAST({u} AS BIGINT) // 10 AS VARCHAR) || '.' || CAST(CAST({u} AS BIGINT) % 10 AS VARCHAR) || ' %)'"


add(
    "proc_tendency_average",
    lambda r: instance.proc_tendency_with_average(r, B, E),
    _proc(
        f"""SELECT ts AS "timestamp", {", ".join(f"CAST({s} AS DOUBLE) AS {s}, {_tenths(f'{s}_tenths')} AS {s}_per" for s in _ST)} FROM p
UNION ALL SELECT 'Average', {", ".join(f"{avg3(s, 1)}, {_tenths(units(f'SUM({s}_tenths)', 'COUNT(*)', 0))}" for s in _ST)} FROM p"""
    ),
)
_WAL = f"""
WITH m AS (SELECT snapid, time, location, xlogfile, last_archived_wal, archived_count, failed_count,
                  CAST('0x' || split_part(location, '/', 1) AS BIGINT) * 4294967296 + CAST('0x' || split_part(location, '/', 2) AS BIGINT) AS pos
           FROM xlog JOIN o_scope USING (snapid) LEFT JOIN archive USING (snapid)),
     d AS (SELECT *, pos - LAG(pos) OVER w AS moved, epoch_us(time) - epoch_us(LAG(time) OVER w) AS us,
                  archived_count - LAG(archived_count) OVER w AS ac, failed_count - LAG(failed_count) OVER w AS fc
           FROM m WINDOW w AS (ORDER BY snapid)),
     r AS (SELECT *, {units("moved", "1048576")} AS size3,
                  CASE WHEN us > 0 THEN {units(units("moved * 1000000", "us"), "1048576000")} END AS speed3
           FROM d WHERE snapid > {B})
"""
add(
    "wal_tendency",
    lambda r: instance.wal_tendency(r, B, E),
    _WAL
    + f"""SELECT {mins("time")} AS "timestamp", location, xlogfile AS walfile, CAST(size3 AS DOUBLE) / 1000 AS write_size,
       CAST(speed3 AS DOUBLE) / 1000 AS write_size_per_sec, last_archived_wal, ac AS archive_count, fc AS archive_failed FROM r""",
)
add(
    "wal_stats",
    lambda r: instance.wal_stats(r, B, E),
    _WAL
    + f"""SELECT CAST(SUM(size3) AS DOUBLE) / 1000 AS write_total, {ratio("SUM(speed3)", "COUNT(speed3)", 0)} / 1000 AS write_speed,
       CAST(SUM(ac) AS BIGINT) AS archive_total, CAST(SUM(fc) AS BIGINT) AS archive_failed, MAX(xlogfile) AS last_wal_file,
       MAX(last_archived_wal) AS last_archive_file FROM r""",
)
_WC = instance.WAL_COUNTERS


def _wal_out(c: str, v: str) -> str:
    return f"CAST({v} AS DOUBLE) AS {c}" if c in ("wal_bytes", "wal_write_time", "wal_sync_time") else f"{big(v)} AS {c}"


add(
    "stat_wal",
    lambda r: instance.stat_wal(r, B, E),
    f"""
SELECT {", ".join(_wal_out(c, f"CASE WHEN e.stats_reset = b.stats_reset THEN e.{c} - b.{c} ELSE e.{c} END") for c in _WC)},
       strftime(e.stats_reset, '%Y-%m-%d %H:%M:%S.%f') AS stats_reset
FROM stat_wal e CROSS JOIN stat_wal b WHERE e.snapid = {E} AND b.snapid = {B}""",
)
add(
    "stat_wal_same_reset",
    lambda r: instance.stat_wal(r, B, B + 10),
    f"""
SELECT {", ".join(_wal_out(c, f"CASE WHEN e.stats_reset = b.stats_reset THEN e.{c} - b.{c} ELSE e.{c} END") for c in _WC)},
       strftime(e.stats_reset, '%Y-%m-%d %H:%M:%S.%f') AS stats_reset
FROM stat_wal e CROSS JOIN stat_wal b WHERE e.snapid = {B + 10} AND b.snapid = {B}""",
)
add(
    "stat_wal2",
    lambda r: instance.stat_wal2(r, B, E),
    f"""
SELECT {mins("time")} AS time, {", ".join(_wal_out(c, f"{c} - LAG({c}) OVER (ORDER BY snapid)") for c in _WC[1:])}
FROM stat_wal JOIN o_scope USING (snapid)""",
)
_IO = [c for c in instance.IO_COUNTERS if c != "op_bytes"]
add(
    "stat_io",
    lambda r: instance.stat_io(r, B, E),
    f"""
SELECT {mins("time")} AS time, backend_type, object, context, op_bytes, CAST(NULL AS VARCHAR) AS stats_reset,
       {", ".join(f"{c} - COALESCE(LAG({c}) OVER w, 0) AS {c}" for c in _IO)}
FROM stat_io JOIN o_scope USING (snapid) WINDOW w AS (PARTITION BY backend_type, object, context ORDER BY snapid)""",
)
add(
    "xid_tendency",
    lambda r: instance.xid_tendency(r, B, E),
    f"""
WITH l AS (SELECT snapid, time, xid_current - LAG(xid_current) OVER (ORDER BY snapid) AS x FROM snapshot WHERE instid = 1)
SELECT {mins("time")} AS "timestamp", CAST(x AS DOUBLE) AS xid_increase FROM l WHERE snapid BETWEEN {B} AND {E}""",
)
_BG = f"""
WITH m AS (SELECT snapid, time, buffers_clean AS bgwriter_write, writes AS backend_write, fsyncs AS backend_fsync,
                  maxwritten_clean AS bgwriter_stopscan, buffers_alloc AS buffer_alloc
           FROM bgwriter JOIN o_scope USING (snapid)
                JOIN (SELECT snapid, writes, fsyncs FROM stat_io WHERE backend_type = 'client backend') i USING (snapid)),
     r AS (SELECT snapid, {mins("time")} AS ts, epoch_us(time) - epoch_us(LAG(time) OVER w) AS us,
                  {", ".join(f"{c} - LAG({c}) OVER w AS {c}" for c in instance._BGWRITER)}
           FROM m WINDOW w AS (ORDER BY snapid))
"""
add(
    "bgwriter_tendency",
    lambda r: instance.bgwriter_tendency(r, B, E),
    _BG + f'SELECT ts AS "timestamp", {", ".join(f"{tps(c, "us")} AS {c}_tps" for c in instance._BGWRITER)} FROM r WHERE snapid > {B}',
)
_BGU = {c: units(f"({c}) * 1000000", "us") for c in instance._BGWRITER}
add(
    "bgwriter_stats",
    lambda r: instance.bgwriter_stats(r, B, E),
    _BG
    + "SELECT "
    + ", ".join(
        [f"{ratio(f'SUM({u})', 'COUNT(*)', 0)} / 1000 AS {c}_avg" for c, u in _BGU.items()]
        + [f"CAST(MAX({_BGU[c]}) AS DOUBLE) / 1000 AS {c}_max" for c in ("bgwriter_write", "backend_write", "backend_fsync")]
    )
    + f" FROM r WHERE snapid > {B}",
)
add(
    "ht_info",
    lambda r: instance.ht_info(r, B, E),
    "SELECT "
    + ", ".join(
        f"e.{s}_dealloc - b.{s}_dealloc AS {s}_dealloc, strftime(e.{s}_reset, '%Y-%m-%d %H:%M:%S.%f') AS {s}_reset"
        for s in ("statements", "wait_sampling", "rusage")
    )
    + f" FROM ht_info e CROSS JOIN ht_info b WHERE e.snapid = {E} AND b.snapid = {B}",
)

# --- operating system --------------------------------------------------------
_CPU = f"""
WITH l AS (SELECT snapid, time,
                  {", ".join(f"cpu_{s} + overflow_{s} * 4294967296 - LAG(cpu_{s}) OVER w AS {s}_" for s in resources.CPU_STATES)}
           FROM cpu JOIN o_scope USING (snapid) WINDOW w AS (ORDER BY snapid)),
     c AS (SELECT snapid, time, {", ".join(f"{div3(f'{s}_', 'user_ + system_ + idle_ + iowait_')} AS {s}3" for s in resources.CPU_STATES)}
           FROM l WHERE snapid > {B})
"""
_SHARES = ", ".join(f'CAST({s}3 AS DOUBLE) / 10 AS "{s}"' for s in resources.CPU_STATES)
add(
    "cpu_usage_tendency",
    lambda r: resources.cpu_usage_tendency(r, B, E),
    _CPU + f"SELECT snapid, {_SHARES} FROM c",
)
add(
    "cpu_usage_tendency_report",
    lambda r: resources.cpu_usage_tendency_report(r, B, E),
    _CPU + f'SELECT {mins("time")} AS "timestamp", {_SHARES} FROM c',
)
_LOADS = ", ".join(f"round(CAST({c} AS DOUBLE), 3) AS {c}" for c in ("loadavg1", "loadavg5", "loadavg15"))
add(
    "cpu_loadavg_tendency",
    lambda r: resources.cpu_loadavg_tendency(r, B, E),
    _CPU + f'SELECT {mins("time")} AS "timestamp", {_SHARES}, {_LOADS} FROM c JOIN loadavg USING (snapid)',
)
add(
    "cpu_loadavg_average",
    lambda r: resources.cpu_loadavg_with_average(r, B, E),
    _CPU
    + f"""SELECT {mins("time")} AS "timestamp", {_SHARES}, {_LOADS} FROM c JOIN loadavg USING (snapid)
UNION ALL
SELECT 'Average', {", ".join(f"{ratio(f'SUM({s}3)', 'COUNT(*)', 0)} / 10" for s in resources.CPU_STATES)},
       {", ".join(f"{ratio(f'SUM(CAST(round(CAST({c} AS DOUBLE) * 1000) AS BIGINT))', 'COUNT(*)', 0)} / 1000" for c in ("loadavg1", "loadavg5", "loadavg15"))}
FROM c JOIN loadavg USING (snapid)""",
)
add(
    "loadavg_tendency",
    lambda r: resources.loadavg_tendency(r, B, E),
    f"""
SELECT {mins("time")} AS "timestamp", {", ".join(f'round(CAST(loadavg{m} AS DOUBLE), 3) AS "{m}min"' for m in (1, 5, 15))}
FROM loadavg JOIN o_scope USING (snapid)""",
)
add(
    "memory_tendency",
    lambda r: resources.memory_tendency(r, B, E),
    f"""
SELECT {mins("time")} AS "timestamp", {", ".join(f"{ratio(g, '1024', 2)} AS {g}" for g in ("memfree", "buffers", "cached", "swap", "dirty"))}
FROM memory JOIN o_scope USING (snapid)""",
)
_DEV = {"readsector": "drs", "writesector": "dws", "readtime": "drt", "writetime": "dwt", "iototaltime": "dit"}
add(
    "io_usage",
    lambda r: resources.io_usage(r, B, E),
    f"""
WITH l AS (SELECT *, {", ".join(f"device_{c} + overflow_{o} * 4294967296 - LAG(device_{c}) OVER w AS m_{c}" for c, o in _DEV.items())}
           FROM device JOIN o_scope USING (snapid) WINDOW w AS (PARTITION BY device_name ORDER BY snapid)),
     k AS (SELECT * FROM l WHERE snapid > {B}),
     n AS (SELECT device_name, string_agg(t, ',' ORDER BY t) AS spaces
           FROM (SELECT DISTINCT device_name, unnest(device_tblspaces) AS t FROM k) u GROUP BY device_name)
SELECT device_name, spaces AS device_tblspaces, {big(units("SUM(m_readsector)", "2048", 0))} AS total_read,
       {big(units("SUM(m_writesector)", "2048", 0))} AS total_write, {big("SUM(m_readtime)")} AS total_read_time,
       {big("SUM(m_writetime)")} AS total_write_time, {avg3("device_ioqueue")} AS io_queue,
       {big("SUM(m_iototaltime)")} AS total_io_time, MAX(device_rsps_max) / 2 AS read_size_tps_peak,
       MAX(device_wsps_max) / 2 AS write_size_tps_peak
FROM k JOIN n USING (device_name) GROUP BY device_name, spaces""",
)


def _rate(c: str, by: int, scale: int) -> str:
    three = units(f"({c}) * 1000000", "us")
    return f"COALESCE(CASE WHEN us > 0 THEN {ratio(three, str(by * 1000), scale)} ELSE 0.0 END, 0.0)"


add(
    "io_usage_tendency",
    lambda r: resources.io_usage_tendency(r, B, E),
    f"""
WITH l AS (SELECT *, epoch_us(time) - epoch_us(LAG(time) OVER w) AS us,
                  {", ".join(f"device_{c} + overflow_{o} * 4294967296 - LAG(device_{c}) OVER w AS m_{c}" for c, o in _DEV.items())}
           FROM device JOIN o_scope USING (snapid) WINDOW w AS (PARTITION BY device_name ORDER BY snapid))
SELECT {mins("time")} AS "timestamp", device_name, {_rate("m_readsector", 2, 2)} AS read_size_tps,
       {_rate("m_writesector", 2, 2)} AS write_size_tps, {_rate("m_readtime", 10, 1)} AS read_time_rate,
       {_rate("m_writetime", 10, 1)} AS write_time_rate, device_rsps_max / 2 AS read_size_tps_peak,
       device_wsps_max / 2 AS write_size_tps_peak
FROM l WHERE snapid > {B}""",
)
add(
    "disk_usage_tablespace",
    lambda r: resources.disk_usage_tablespace(r, B, E),
    f"""
SELECT name AS spcname, location, device, {mib("total - avail")} AS used, {mib("avail")} AS avail,
       {ratio(div3("100 * avail", "total"), "1000", 1)} AS remain
FROM tablespace WHERE snapid = {E}""",
)

# --- catalogue ---------------------------------------------------------------
add(
    "report_scope_by_snapid",
    lambda r: catalogue.report_scope_by_snapid(r, B, E),
    f"""
SELECT instid, hostname, {big("port")} AS port, pg_version, MIN(snapid) AS "begin", MAX(snapid) AS "end"
FROM snapshot JOIN instance USING (instid) WHERE snapid BETWEEN {B} AND {E} GROUP BY ALL""",
)
add(
    "report_scope_by_time",
    lambda r: catalogue.report_scope_by_time(r, SINCE, UNTIL),
    f"""
SELECT instid, hostname, {big("port")} AS port, pg_version, MIN(snapid) AS "begin", MAX(snapid) AS "end"
FROM snapshot JOIN instance USING (instid)
WHERE (epoch_us(time) + 500000) // 1000000 BETWEEN epoch_us(TIMESTAMP '{SINCE}') // 1000000 AND epoch_us(TIMESTAMP '{UNTIL}') // 1000000
GROUP BY ALL""",
)
add(
    "scope_filter",
    lambda r: catalogue.reportable(catalogue.report_scope_by_snapid(r, B, B + 2)),
    f"""
SELECT instid, hostname, {big("port")} AS port, pg_version, MIN(snapid) AS "begin", MAX(snapid) AS "end"
FROM snapshot JOIN instance USING (instid) WHERE snapid BETWEEN {B} AND {B + 2} GROUP BY ALL HAVING MIN(snapid) < MAX(snapid)""",
)
add(
    "snapshot_list",
    lambda r: catalogue.snapshot_list(r),
    f"""
SELECT snapid, instid, hostname, {big("port")} AS port, {sec("time")} AS time, comment,
       (exec_time + 500000) // 1000000 AS exec_time, {size_text("snapshot_increase_size")} AS size
FROM snapshot JOIN instance USING (instid)""",
)
_NEAR = "(b + {0} // 2) // {0}"


def _nearest(v: str) -> str:
    steps = "".join(
        f"WHEN b < {10240 * 1024**p} THEN CAST(((b + {1024**p // 2}) // {1024**p}) AS VARCHAR) || ' {u}' "
        for p, u in ((1, "KiB"), (2, "MiB"), (3, "GiB"))
    )
    return f"(CASE WHEN b < 10240 THEN CAST(b AS VARCHAR) || ' bytes' {steps} ELSE CAST(((b + {1024**4 // 2}) // {1024**4}) AS VARCHAR) || ' TiB' END)".replace("b ", f"{v} ").replace("(b", f"({v}")


add(
    "snapshot_size",
    lambda r: catalogue.snapshot_size(r),
    f"""
WITH g AS (SELECT instid, name, hostname, CAST(port AS BIGINT) AS port, COUNT(*) AS snapshots,
                  CAST(SUM(snapshot_increase_size) AS BIGINT) AS vol, MAX(snapid) AS last_snapid, MAX(time) AS t
           FROM snapshot JOIN instance USING (instid) GROUP BY instid, name, hostname, port),
     a AS (SELECT instid, name, hostname, port, snapshots, vol, last_snapid, t FROM g
           UNION ALL SELECT NULL, 'Total', NULL, NULL, CAST(SUM(snapshots) AS BIGINT), CAST(SUM(vol) AS BIGINT), NULL, NULL FROM g)
SELECT instid, name, hostname, port, snapshots, {_nearest("vol")} AS size, last_snapid, {sec("t")} AS last_time FROM a""",
)
