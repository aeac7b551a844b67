"""Repository-shaped frames derived from the test tables.

Each frame is one SELECT that both Spark SQL and DuckDB understand.  ``events``
supplies the snapshots (one per day and instance), databases and event tables,
``lineitem`` the relations, ``orders`` the statements.  Tokens in capitals with a
trailing underscore are the few spots where the dialects differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark import Repository, schemas

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

SPARK = {
    "ARRAY_(": "array(",
    "EXPLODE_(": "explode(",
    "NO_TEXTS_": "CAST(array() AS ARRAY<STRING>)",
    "NO_LONGS_": "CAST(array() AS ARRAY<BIGINT>)",
    "MICROS_(": "unix_micros(",
    "FROM_MICROS_(": "timestamp_micros(",
    "LINE_BREAK_": r"'\n'",
    "TEXTS_OF_": "ARRAY<STRING>",
}
DUCKDB = {
    "ARRAY_(": "list_value(",
    "EXPLODE_(": "unnest(",
    "NO_TEXTS_": "CAST(list_value() AS VARCHAR[])",
    "NO_LONGS_": "CAST(list_value() AS BIGINT[])",
    "MICROS_(": "epoch_us(",
    "FROM_MICROS_(": "make_timestamp(",
    "LINE_BREAK_": "chr(10)",
    "TEXTS_OF_": "VARCHAR[]",
}

F: dict[str, str] = {}

# --- building blocks ---------------------------------------------------------
F["x_events"] = """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, CAST(ROUND(value * 100) AS BIGINT) AS v,
       CAST(EXTRACT(DAY FROM ts) AS BIGINT) AS d, 1 + user_id % 2 AS instid,
       (CAST(EXTRACT(DAY FROM ts) AS BIGINT) - 1) * 2 + 1 + user_id % 2 AS snapid,
       user_id % 97 AS dbid,
       CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS kind
FROM events"""
F["x_snap"] = """
SELECT d, instid, snapid, MAX(ts) AS time, COUNT(*) AS n, CAST(SUM(v) AS BIGINT) AS v
FROM x_events GROUP BY d, instid, snapid"""
F["x_marks"] = """
SELECT d, instid, snapid, time, n, v,
       CAST(SUM(n) OVER (PARTITION BY instid ORDER BY d) AS BIGINT) AS cn,
       CAST(SUM(v) OVER (PARTITION BY instid ORDER BY d) AS BIGINT) AS cv
FROM x_snap"""
F["x_kind"] = """
SELECT d, instid, snapid, event_type, kind, n, v,
       CAST(SUM(n) OVER (PARTITION BY instid, event_type ORDER BY d) AS BIGINT) AS cn,
       CAST(SUM(v) OVER (PARTITION BY instid, event_type ORDER BY d) AS BIGINT) AS cv
FROM (SELECT d, instid, snapid, event_type, kind, COUNT(*) AS n, CAST(SUM(v) AS BIGINT) AS v
      FROM x_events GROUP BY d, instid, snapid, event_type, kind) k"""
F["x_db"] = """
SELECT d, instid, snapid, dbid,
       CAST(SUM(n) OVER w AS BIGINT) AS n, CAST(SUM(v) OVER w AS BIGINT) AS v,
       CAST(SUM(n1) OVER w AS BIGINT) AS n1, CAST(SUM(n2) OVER w AS BIGINT) AS n2,
       CAST(SUM(n3) OVER w AS BIGINT) AS n3, CAST(SUM(n4) OVER w AS BIGINT) AS n4
FROM (SELECT d, instid, snapid, dbid, COUNT(*) AS n, SUM(v) AS v,
             SUM(CASE WHEN kind = 1 THEN 1 ELSE 0 END) AS n1, SUM(CASE WHEN kind = 2 THEN 1 ELSE 0 END) AS n2,
             SUM(CASE WHEN kind = 3 THEN 1 ELSE 0 END) AS n3, SUM(CASE WHEN kind = 4 THEN 1 ELSE 0 END) AS n4
      FROM x_events GROUP BY d, instid, snapid, dbid) g
WINDOW w AS (PARTITION BY instid, dbid ORDER BY d)"""
F["x_rel"] = """
SELECT d, instid, (d - 1) * 2 + instid AS snapid, tbl, tbl % 97 AS dbid, 1 + tbl % 3 AS nsp,
       CAST(SUM(n) OVER w AS BIGINT) AS n, CAST(SUM(q) OVER w AS BIGINT) AS q, CAST(SUM(p) OVER w AS BIGINT) AS p,
       CAST(SUM(r) OVER w AS BIGINT) AS r
FROM (SELECT LEAST(CAST(EXTRACT(DAY FROM l_shipdate) AS BIGINT), 30) AS d, 1 + l_suppkey % 2 AS instid,
             l_partkey AS tbl, COUNT(*) AS n, SUM(CAST(l_quantity AS BIGINT)) AS q,
             SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS p,
             SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r
      FROM lineitem
      GROUP BY LEAST(CAST(EXTRACT(DAY FROM l_shipdate) AS BIGINT), 30), 1 + l_suppkey % 2, l_partkey) g
WINDOW w AS (PARTITION BY instid, tbl ORDER BY d)"""
F["x_orders"] = """
SELECT LEAST(CAST(EXTRACT(DAY FROM o_orderdate) AS BIGINT), 30) AS d, 1 + o_custkey % 2 AS instid,
       (LEAST(CAST(EXTRACT(DAY FROM o_orderdate) AS BIGINT), 30) - 1) * 2 + 1 + o_custkey % 2 AS snapid,
       o_custkey % 97 AS dbid, o_custkey % 5 AS userid, o_custkey AS queryid,
       CAST(SUBSTR(o_orderpriority, 1, 1) AS BIGINT) AS planid, o_orderpriority, o_orderstatus,
       CAST(ROUND(o_totalprice * 100) AS BIGINT) AS p
FROM orders"""
F["x_stmt"] = """
SELECT d, instid, snapid, dbid, userid, queryid,
       CAST(SUM(n) OVER w AS BIGINT) AS n, CAST(SUM(p) OVER w AS BIGINT) AS p
FROM (SELECT d, instid, snapid, dbid, userid, queryid, COUNT(*) AS n, SUM(p) AS p
      FROM x_orders GROUP BY d, instid, snapid, dbid, userid, queryid) g
WINDOW w AS (PARTITION BY instid, dbid, userid, queryid ORDER BY d)"""
F["x_plan"] = """
SELECT d, instid, snapid, dbid, userid, queryid, planid,
       CAST(SUM(n) OVER w AS BIGINT) AS n, CAST(SUM(p) OVER w AS BIGINT) AS p
FROM (SELECT d, instid, snapid, dbid, userid, queryid, planid, COUNT(*) AS n, SUM(p) AS p
      FROM x_orders GROUP BY d, instid, snapid, dbid, userid, queryid, planid) g
WINDOW w AS (PARTITION BY instid, dbid, userid, queryid, planid ORDER BY d)"""

# --- dimensions --------------------------------------------------------------
F["instance"] = """
SELECT instid, CONCAT('sys', CAST(instid AS STRING)) AS name, CONCAT('host', CAST(instid AS STRING)) AS hostname,
       CAST(5431 + instid AS INT) AS port, CONCAT('17.', CAST(instid AS STRING)) AS pg_version,
       CAST(4278190080 AS BIGINT) AS xlog_file_size, CAST(8192 AS INT) AS page_size,
       CAST(24 AS SMALLINT) AS page_header_size, CAST(24 AS SMALLINT) AS htup_header_size,
       CAST(4 AS SMALLINT) AS item_id_size
FROM (SELECT DISTINCT instid FROM x_events) i"""
F["snapshot"] = """
SELECT snapid, instid, time, CONCAT('day ', CAST(d AS STRING)) AS comment, 400000 + v % 5000000 AS exec_time,
       v * 7 AS snapshot_increase_size, CAST(cn AS DECIMAL(20, 0)) AS xid_current
FROM x_marks"""
F["alert"] = """
SELECT instid, CAST(0 AS BIGINT) AS rollback_tps, CAST(1 AS BIGINT) AS commit_tps, CAST(1 AS BIGINT) AS garbage_size,
       30 AS garbage_percent, 45 AS garbage_percent_table, CAST(1000000 AS BIGINT) AS response_avg,
       CAST(4000000 AS BIGINT) AS response_worst, 100 AS backend_max, 40 AS correlation_percent,
       20 AS disk_remain_percent, CAST(7.0 AS FLOAT) AS loadavg_1min, CAST(6.0 AS FLOAT) AS loadavg_5min,
       CAST(-1 AS FLOAT) AS loadavg_15min, 1000000 AS swap_size, 100 AS rep_flush_delay, 200 AS rep_replay_delay,
       instid = 1 AS enable_alert
FROM (SELECT DISTINCT instid FROM x_events) i"""

# --- facts from events -------------------------------------------------------
F["database"] = """
SELECT snapid, dbid, CONCAT('db', CAST(dbid % 61 AS STRING)) AS name, v * 1000 + 1 AS size, CAST(d AS INT) AS age,
       v AS xact_commit, n3 AS xact_rollback, n2 * 3 AS blks_read, v AS blks_hit, v * 2 AS tup_returned,
       n AS tup_fetched, n4 AS tup_inserted, n1 AS tup_updated, n3 AS tup_deleted, n1 AS confl_tablespace,
       n2 AS confl_lock, n3 AS confl_snapshot, n4 AS confl_bufferpin, n AS confl_deadlock, n1 AS temp_files,
       v * 5000 AS temp_bytes, n3 AS deadlocks, CAST(v AS DOUBLE) / 8 AS blk_read_time,
       CAST(n AS DOUBLE) / 4 AS blk_write_time
FROM x_db"""
F["schema"] = """
SELECT snapid, dbid, nsp, CASE nsp WHEN 1 THEN 'public' WHEN 2 THEN 'app' ELSE 'pg_toast' END AS name
FROM (SELECT snapid, dbid, EXPLODE_(ARRAY_(1, 2, 3)) AS nsp FROM x_db) s"""
F["role"] = """
SELECT DISTINCT snapid, user_id % 5 AS userid, CONCAT('role', CAST(user_id % 5 AS STRING)) AS name FROM x_events"""
F["rusage"] = """
SELECT snapid, dbid, userid, queryid, CAST(SUM(n) OVER w AS BIGINT) AS plan_reads,
       CAST(SUM(n * 2) OVER w AS BIGINT) AS plan_writes, CAST(SUM(v) OVER w AS DOUBLE) / 8 AS plan_user_time,
       CAST(SUM(n) OVER w AS DOUBLE) / 4 AS plan_system_time, CAST(SUM(v) OVER w AS BIGINT) AS exec_reads,
       CAST(SUM(v + n) OVER w AS BIGINT) AS exec_writes, CAST(SUM(v) OVER w AS DOUBLE) / 16 AS exec_user_time,
       CAST(SUM(n) OVER w AS DOUBLE) / 2 AS exec_system_time
FROM (SELECT d, instid, snapid, dbid, userid, queryid, COUNT(*) AS n, SUM(p) AS v
      FROM x_orders GROUP BY d, instid, snapid, dbid, userid, queryid) g
WINDOW w AS (PARTITION BY instid, dbid, userid, queryid, CASE WHEN d >= 16 THEN 1 ELSE 0 END ORDER BY d)"""
F["activity"] = """
SELECT snapid, CAST(n % 700 AS INT) AS idle, CAST(v % 300 AS INT) AS idle_in_xact, CAST(n % 90 AS INT) AS waiting,
       CAST(v % 500 AS INT) AS running, CAST(v % 211 AS INT) AS max_backends
FROM x_marks"""
F["setting"] = """
SELECT snapid, CONCAT('param_', event_type) AS name, CAST(n % 4 AS STRING) AS setting,
       CASE WHEN kind = 1 THEN NULL ELSE 'ms' END AS unit, 'configuration file' AS source
FROM x_kind WHERE NOT (kind = 1 AND d < 10) AND NOT (kind = 2 AND d > 20)
UNION ALL
SELECT snapid, 'agent.sampling_interval', '7', 's', 'configuration file' FROM x_marks WHERE d > 12"""
F["archive"] = """
SELECT snapid, cn AS archived_count, CONCAT('wal', CAST(cn AS STRING)) AS last_archived_wal, v AS failed_count
FROM x_marks"""
F["xlog"] = """
SELECT snapid,
       CONCAT(HEX(CAST(FLOOR(cv * 20000 / 4294967296) AS BIGINT)), '/', HEX(cv * 20000 % 4294967296)) AS location,
       CONCAT('seg', CAST(1000000 + cn AS STRING)) AS xlogfile
FROM x_marks"""
F["stat_wal"] = """
SELECT snapid, CAST(SUM(n) OVER w AS BIGINT) AS wal_records, CAST(SUM(n * 2) OVER w AS BIGINT) AS wal_fpi,
       CAST(SUM(v * 100) OVER w AS DECIMAL(30, 0)) AS wal_bytes, CAST(SUM(v) OVER w AS BIGINT) AS wal_buffers_full,
       CAST(SUM(n + v) OVER w AS BIGINT) AS wal_write, CAST(SUM(n * 5) OVER w AS BIGINT) AS wal_sync,
       CAST(SUM(v) OVER w AS DOUBLE) / 8 AS wal_write_time, CAST(SUM(n) OVER w AS DOUBLE) / 4 AS wal_sync_time,
       MIN(time) OVER w AS stats_reset
FROM x_marks WINDOW w AS (PARTITION BY instid, CASE WHEN d >= 16 THEN 1 ELSE 0 END ORDER BY d)"""
F["bgwriter"] = """
SELECT snapid, cv AS buffers_clean, cn AS maxwritten_clean, cv * 3 AS buffers_alloc FROM x_marks"""
F["stat_io"] = """
SELECT snapid, CASE WHEN kind = 1 THEN 'client backend' ELSE event_type END AS backend_type, 'relation' AS object,
       'normal' AS context, cn AS reads, CAST(cv AS DOUBLE) / 8 AS read_time, cv AS writes,
       CAST(cn AS DOUBLE) / 4 AS write_time, cn * 2 AS writebacks, CAST(cn AS DOUBLE) / 2 AS writeback_time,
       cn + cv AS extends, CAST(cn AS DOUBLE) AS extend_time, CAST(8192 AS BIGINT) AS op_bytes, cv * 9 AS hits,
       cn * 7 AS evictions, cn * 3 AS reuses, cn * 2 AS fsyncs, CAST(cv AS DOUBLE) / 4 AS fsync_time
FROM x_kind"""
F["x_cpu"] = """
SELECT snapid, instid, d, cv * 4000 % 4294967296 AS u, cn * 90000 % 4294967296 AS s, cv * 90000 % 4294967296 AS i,
       cn * 1000 AS w
FROM x_marks"""
F["cpu"] = """
SELECT snapid, 'cpu' AS cpu_id, u AS cpu_user, s AS cpu_system, i AS cpu_idle, w AS cpu_iowait,
       CAST(CASE WHEN u < LAG(u) OVER q THEN 1 ELSE 0 END AS SMALLINT) AS overflow_user,
       CAST(CASE WHEN s < LAG(s) OVER q THEN 1 ELSE 0 END AS SMALLINT) AS overflow_system,
       CAST(CASE WHEN i < LAG(i) OVER q THEN 1 ELSE 0 END AS SMALLINT) AS overflow_idle,
       CAST(CASE WHEN w < LAG(w) OVER q THEN 1 ELSE 0 END AS SMALLINT) AS overflow_iowait
FROM x_cpu WINDOW q AS (PARTITION BY instid ORDER BY d)"""
F["loadavg"] = """
SELECT snapid, CAST(CAST(v % 1000 AS DOUBLE) / 100 AS FLOAT) AS loadavg1,
       CAST(CAST(v % 900 AS DOUBLE) / 100 AS FLOAT) AS loadavg5, CAST(CAST(v % 700 AS DOUBLE) / 100 AS FLOAT) AS loadavg15
FROM x_marks"""
F["memory"] = """
SELECT snapid, v AS memfree, n * 1000 AS buffers, v * 3 AS cached, v * 9 % 2000000 AS swap, n AS dirty FROM x_marks"""
F["x_dev"] = """
SELECT snapid, instid, d, event_type, kind, cv * 7000 % 4294967296 AS rs, cv * 9000 % 4294967296 AS ws,
       cn * 800000 % 4294967296 AS rt, cv * 500 AS wt, cv * 1500 AS it, n, v
FROM x_kind"""
F["device"] = """
SELECT snapid, '8' AS device_major, CAST(kind AS STRING) AS device_minor, CONCAT('sd', event_type) AS device_name,
       rs AS device_readsector, rt AS device_readtime, ws AS device_writesector, wt AS device_writetime,
       n % 50 AS device_ioqueue, it AS device_iototaltime, CAST(n * 8 AS DOUBLE) AS device_rsps_max,
       CAST(n * 16 AS DOUBLE) AS device_wsps_max,
       CAST(CASE WHEN rs < LAG(rs) OVER q THEN 1 ELSE 0 END AS SMALLINT) AS overflow_drs,
       CAST(CASE WHEN rt < LAG(rt) OVER q THEN 1 ELSE 0 END AS SMALLINT) AS overflow_drt,
       CAST(CASE WHEN ws < LAG(ws) OVER q THEN 1 ELSE 0 END AS SMALLINT) AS overflow_dws,
       CAST(CASE WHEN wt < LAG(wt) OVER q THEN 1 ELSE 0 END AS SMALLINT) AS overflow_dwt,
       CAST(CASE WHEN it < LAG(it) OVER q THEN 1 ELSE 0 END AS SMALLINT) AS overflow_dit,
       CASE WHEN d % 2 = 0 THEN ARRAY_('pg_default', CONCAT('ts_', event_type)) ELSE ARRAY_('pg_global') END AS device_tblspaces
FROM x_dev WINDOW q AS (PARTITION BY instid, event_type ORDER BY d)"""
F["tablespace"] = """
SELECT snapid, kind AS tbs, CONCAT('ts_', event_type) AS name, CONCAT('/data/', event_type) AS location,
       CONCAT('8:', CAST(kind % 3 AS STRING)) AS device, v * 1000000 AS avail, v * 1000000 + n * 20000000000 AS total
FROM x_kind"""
F["ht_info"] = """
SELECT snapid, cn AS statements_dealloc, time AS statements_reset, cv AS wait_sampling_dealloc,
       time AS wait_sampling_reset, cn * 2 AS rusage_dealloc, time AS rusage_reset
FROM x_marks"""
F["profile"] = """
SELECT snapid, CONCAT('proc_', event_type) AS processing, v AS execute, CAST(n AS DOUBLE) AS total_exec_time FROM x_kind"""
F["xact"] = """
SELECT snapid, CASE WHEN user_id % 4 = 0 THEN NULL ELSE CONCAT('10.0.0.', CAST(user_id % 250 AS STRING)) END AS client,
       CAST(user_id AS INT) AS pid, DATE_TRUNC('month', ts) AS start, CAST(SUM(v) AS DOUBLE) / 64 AS duration,
       MAX(CONCAT('select ', CAST(event_id AS STRING))) AS query
FROM x_events GROUP BY snapid, user_id, DATE_TRUNC('month', ts)"""
F["lock"] = """
SELECT snapid, rel % 97 AS dbid, CASE WHEN rel % 3 = 0 THEN NULL ELSE 'public' END AS nspname,
       CAST(rel AS STRING) AS relname, CAST(100 + user_id % 40 AS INT) AS blockee_pid, CAST(200 + rel % 3 AS INT) AS blocker_pid,
       CASE WHEN rel % 2 = 0 THEN NULL ELSE 'gid' END AS blocker_gid, MAX(v) * 1000 AS duration,
       CONCAT('upd ', CAST(user_id % 40 AS STRING)) AS blockee_query, MAX(CONCAT('blk ', CAST(event_id AS STRING))) AS blocker_query
FROM (SELECT snapid, user_id, event_id, v, v % 200 AS rel FROM x_events WHERE kind = 3) e
GROUP BY snapid, rel, user_id % 40"""
F["replication"] = """
SELECT snapid, CAST(100 + kind AS INT) AS procpid, CAST(10 AS BIGINT) AS usesysid, 'rep' AS usename,
       CASE WHEN kind = 2 THEN '' ELSE event_type END AS application_name,
       CASE WHEN kind = 5 THEN NULL ELSE CONCAT('10.1.0.', CAST(kind AS STRING), '/32') END AS client_addr,
       CAST(NULL AS STRING) AS client_hostname, CAST(5000 + kind AS INT) AS client_port,
       FROM_MICROS_(1704067200000000 + kind * 1500000) AS backend_start, CAST(NULL AS BIGINT) AS backend_xmin,
       'streaming' AS state,
       CONCAT(HEX(CAST(FLOOR(cv * 90000 / 4294967296) AS BIGINT)), '/', HEX(cv * 90000 % 4294967296), ' (w)') AS current_location,
       'x' AS sent_location, 'x' AS write_location,
       CASE WHEN d % 6 = 1 THEN NULL ELSE CONCAT(HEX(CAST(FLOOR((cv * 90000 - v * 4000) / 4294967296) AS BIGINT)), '/',
            HEX((cv * 90000 - v * 4000) % 4294967296), ' (w)') END AS flush_location,
       CONCAT(HEX(CAST(FLOOR((cv * 90000 - v * 7000) / 4294967296) AS BIGINT)), '/',
            HEX((cv * 90000 - v * 7000) % 4294967296), ' (w)') AS replay_location,
       n * 1000 AS write_lag, n * 2000 AS flush_lag, n * 3001 AS replay_lag, CAST(kind - 1 AS INT) AS sync_priority,
       CASE WHEN kind = 3 THEN 'sync' ELSE 'async' END AS sync_state
FROM x_kind"""
F["replication_slots"] = """
SELECT snapid, CONCAT('slot_', event_type) AS slot_name, 'pgoutput' AS plugin,
       CASE WHEN kind = 1 THEN 'physical' ELSE 'logical' END AS slot_type, n % 97 AS datoid,
       CAST(100 + kind AS INT) AS active_pid
FROM x_kind WHERE kind < 4"""
F["stat_replication_slots"] = """
SELECT snapid, CONCAT('slot_', event_type) AS slot_name, CAST(SUM(n) OVER w AS BIGINT) AS spill_txns,
       CAST(SUM(n * 2) OVER w AS BIGINT) AS spill_count, CAST(SUM(v) OVER w AS BIGINT) AS spill_bytes,
       CAST(SUM(n * 3) OVER w AS BIGINT) AS stream_txns, CAST(SUM(n * 4) OVER w AS BIGINT) AS stream_count,
       CAST(SUM(v * 2) OVER w AS BIGINT) AS stream_bytes, CAST(SUM(n * 5) OVER w AS BIGINT) AS total_txns,
       CAST(SUM(v * 3) OVER w AS BIGINT) AS total_bytes,
       CASE WHEN kind = 3 THEN NULL ELSE FROM_MICROS_(1704067200000000 + kind * 1000000 + CASE WHEN kind = 2 AND d >= 16 THEN 86400000000 ELSE 0 END) END AS stats_reset
FROM x_kind WINDOW w AS (PARTITION BY instid, event_type, CASE WHEN kind = 2 AND d >= 16 THEN 1 ELSE 0 END ORDER BY d)"""
F["alert_message"] = """
SELECT snapid, CONCAT('alert ', CAST(event_id AS STRING)) AS message FROM x_events"""
F["cpuinfo"] = """
SELECT instid, time AS timestamp, 'vendor' AS vendor_id, CONCAT('model ', CAST(n % 3 AS STRING)) AS model_name,
       CAST(2400 AS FLOAT) AS cpu_mhz, CAST(n % 8 + 1 AS INT) AS processors, CAST(2 AS INT) AS threads_per_core,
       CAST(n % 4 + 1 AS INT) AS cores_per_socket, CAST(n % 2 + 1 AS INT) AS sockets
FROM x_marks"""
F["meminfo"] = """
SELECT instid, time AS timestamp, v * 100000 AS mem_total FROM x_marks"""

# --- event tables ------------------------------------------------------------
F["x_names"] = """
SELECT event_id, ts, instid, kind, v, user_id, CONCAT('db', CAST(dbid % 61 AS STRING)) AS database,
       CASE user_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'app' ELSE 'pg_toast' END AS schema,
       CONCAT('t', CAST(user_id % 211 AS STRING)) AS tbl
FROM x_events"""
F["autovacuum"] = """
SELECT instid, ts AS start, database, schema, tbl AS table, CAST(event_id % 3 AS INT) AS index_scans,
       v AS page_removed, v * 2 AS page_remain, v % 100 AS tbl_scan_pages, CAST(v % 100 AS DOUBLE) / 4 AS tbl_scan_pages_ratio,
       v AS tup_removed, v * 3 AS tup_remain, v % 17 AS tup_dead, CAST(event_id AS DECIMAL(20, 0)) AS removable_cutoff,
       CAST(v AS DOUBLE) / 8 AS read_rate, CAST(v AS DOUBLE) / 16 AS write_rate, v AS page_hit, v % 31 AS page_miss,
       v % 7 AS page_dirty, v * 4 AS wal_records, v % 11 AS wal_page_images, v * 50 AS wal_bytes,
       CAST(CAST(v AS DOUBLE) / 4 AS FLOAT) AS duration, CASE WHEN v % 2 = 0 THEN v % 5 END AS tup_miss_dead,
       CASE WHEN v % 2 = 0 THEN v % 3 END AS tup_miss_dead_pages, CAST(event_id + 5 AS DECIMAL(20, 0)) AS new_relfrozenxid,
       CAST(CASE WHEN v % 3 = 0 THEN event_id END AS DECIMAL(20, 0)) AS new_relminmxid,
       CAST(1 + v % 4 AS INT) AS index_scan_ptn, v % 13 AS dead_lp_pages, CAST(v % 13 AS DOUBLE) / 8 AS dead_lp_pages_ratio,
       v % 19 AS dead_lp,
       CASE v % 3 WHEN 0 THEN NO_TEXTS_ WHEN 1 THEN ARRAY_('i1') ELSE ARRAY_('i1', 'i2') END AS index_names,
       CASE v % 3 WHEN 0 THEN NO_LONGS_ WHEN 1 THEN ARRAY_(v) ELSE ARRAY_(v, v * 2) END AS index_pages_total,
       CASE v % 3 WHEN 0 THEN NO_LONGS_ WHEN 1 THEN ARRAY_(v % 5) ELSE ARRAY_(v % 5, v % 7) END AS index_pages_new_del,
       CASE v % 3 WHEN 0 THEN NO_LONGS_ WHEN 1 THEN ARRAY_(v % 9) ELSE ARRAY_(v % 9, v % 8) END AS index_pages_current_del,
       CASE v % 3 WHEN 0 THEN NO_LONGS_ WHEN 1 THEN ARRAY_(v % 4) ELSE ARRAY_(v % 4, v % 6) END AS index_pages_reusable,
       CASE WHEN v % 2 = 0 THEN CAST(v AS DOUBLE) / 8 END AS io_timings_read,
       CASE WHEN v % 2 = 0 THEN CAST(v AS DOUBLE) / 4 END AS io_timings_write
FROM x_names WHERE kind IN (1, 2, 4)"""
F["autoanalyze"] = """
SELECT instid, ts AS start, database, schema, tbl AS table, v AS page_hit, v % 31 AS page_miss, v % 7 AS page_dirty,
       CAST(v AS DOUBLE) / 8 AS read_rate, CAST(v AS DOUBLE) / 16 AS write_rate,
       CAST(CAST(v AS DOUBLE) / 4 AS FLOAT) AS duration, CASE WHEN v % 2 = 0 THEN CAST(v AS DOUBLE) / 8 END AS io_timings_read,
       CASE WHEN v % 2 = 0 THEN CAST(v AS DOUBLE) / 4 END AS io_timings_write
FROM x_names WHERE kind IN (2, 5)"""
F["autovacuum_cancel"] = """
SELECT instid, ts AS timestamp, database, schema, tbl AS table, 'ddl' AS query FROM x_names WHERE kind = 3"""
F["autoanalyze_cancel"] = """
SELECT instid, ts AS timestamp, database, schema, tbl AS table, 'ddl' AS query FROM x_names WHERE kind = 4"""
F["checkpoint"] = """
SELECT instid, ts AS start, CASE event_id % 3 WHEN 0 THEN 'time' WHEN 1 THEN 'wal' ELSE 'immediate force wait' END AS flags,
       v AS num_buffers, CAST(CAST(v AS DOUBLE) / 8 AS FLOAT) AS total_duration
FROM x_events WHERE kind = 4"""

# --- relations ---------------------------------------------------------------
F["table"] = """
SELECT snapid, dbid, tbl, nsp, CAST(NULL AS DATE) AS date, CONCAT('t', CAST(tbl % 211 AS STRING)) AS name,
       CASE WHEN tbl % 4 = 0 THEN tbl + 97 * 3 ELSE 0 END AS toastrelid,
       CASE WHEN tbl % 5 = 0 THEN 't' ELSE 'r' END AS relkind, CAST(p % 3000 AS INT) AS relpages,
       CAST(n * 10 AS FLOAT) AS reltuples,
       CASE WHEN tbl % 2 = 0 THEN ARRAY_('autovacuum_enabled=true', CONCAT('fillfactor=', CAST(50 + tbl % 50 AS STRING))) END AS reloptions,
       p * 8 AS size, n AS seq_scan, q AS seq_tup_read, CASE WHEN tbl % 3 = 0 THEN NULL ELSE n * 2 END AS idx_scan,
       q AS n_tup_ins, n * 7 AS n_tup_upd, r AS n_tup_del, q % 50 AS n_tup_hot_upd, q * 40 AS n_live_tup, p % 5000 AS n_dead_tup,
       q % 101 AS n_mod_since_analyze, n * 3 AS heap_blks_read, p AS heap_blks_hit,
       CASE WHEN tbl % 3 = 0 THEN NULL ELSE q END AS idx_blks_read, q * 3 AS idx_blks_hit,
       r AS toast_blks_read, r * 5 AS toast_blks_hit, n AS tidx_blks_read, n * 9 AS tidx_blks_hit
FROM x_rel"""
F["index"] = """
SELECT snapid, dbid, tbl * 10 AS idx, tbl, CAST(NULL AS DATE) AS date, CONCAT('ix', CAST(tbl AS STRING)) AS name,
       tbl % 3 = 1 AS isclustered, ARRAY_(CAST(1 + tbl % 3 AS SMALLINT), CAST(2 AS SMALLINT)) AS indkey,
       CASE WHEN tbl % 7 = 0 THEN 'broken' ELSE CONCAT('CREATE INDEX ix ON t USING btree (c', CAST(tbl % 3 AS STRING), ', lower(d))') END AS indexdef,
       p * 2 AS size, n AS idx_scan, q * 2 AS idx_tup_read, q AS idx_tup_fetch, n * 4 AS idx_blks_read, p AS idx_blks_hit
FROM x_rel"""
F["column"] = """
SELECT snapid, dbid, tbl, CAST(attnum AS SMALLINT) AS attnum, CAST(NULL AS DATE) AS date,
       CONCAT('c', CAST(attnum AS STRING)) AS name, CAST(4 + (tbl * attnum) % 60 AS INT) AS avg_width,
       CASE WHEN (tbl + attnum) % 6 = 0 THEN NULL
            ELSE CAST(CAST((tbl * 37 + attnum * 11) % 201 - 100 AS DOUBLE) / 100 AS FLOAT) END AS correlation
FROM (SELECT snapid, dbid, tbl, EXPLODE_(ARRAY_(1, 2, 3)) AS attnum FROM x_rel) a"""

# --- server log and samples --------------------------------------------------
_V3 = "LPAD(CAST(v % 1000 AS STRING), 3, '0')"
_TARGET = """CONCAT('"db', CAST(dbid % 61 AS STRING), '.s', CAST(user_id % 3 AS STRING), '.t', CAST(user_id % 211 AS STRING), '"')"""


def _opt(test: str, *parts: str) -> str:
    return f"CASE WHEN {test} THEN CONCAT({', '.join(parts)}, LINE_BREAK_) ELSE '' END"


def _str(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


_INDEX_LINE = "'index \"{0}\": pages: ', CAST(v AS STRING), ' in total, ', CAST(v % 5 AS STRING), ' newly deleted, ', CAST(v % 9 AS STRING), ' currently deleted, ', CAST(v % 4 AS STRING), ' reusable'"
_SCAN = "CASE v % 4 WHEN 0 THEN 'not needed' WHEN 1 THEN 'needed' WHEN 2 THEN 'bypassed' ELSE 'bypassed by failsafe' END"
_TAIL = f"""'avg read rate: ', {_str("v % 9")}, '.125 MB/s, avg write rate: ', {_str("v % 8")}, '.500 MB/s', LINE_BREAK_,
  'buffer usage: ', {_str("v")}, ' hits, ', {_str("v % 31")}, ' misses, ', {_str("v % 7")}, ' dirtied', LINE_BREAK_"""
_USAGE_LINE = f"""'system usage: CPU: user: 0.01 s, system: 0.02 s, elapsed: ', {_str("v % 100")}, '.25 s'"""
_VACUUM = f"""CONCAT('automatic vacuum of table ', {_TARGET}, ': index scans: ', {_str("v % 3")}, LINE_BREAK_,
  'pages: ', {_str("v % 13")}, ' removed, ', {_str("v * 2")}, ' remain, ', {_str("v % 100")}, ' scanned (', {_str("v % 100")}, '.25% of total)', LINE_BREAK_,
  'tuples: ', {_str("v")}, ' removed, ', {_str("v * 3")}, ' remain, ', {_str("v % 17")}, ' are dead but not yet removable', LINE_BREAK_,
  {_opt("v % 2 = 0", "'tuples missed: '", _str("v % 5"), "' dead from '", _str("v % 3"), "' pages not removed due to cleanup lock contention'")},
  'removable cutoff: ', {_str("event_id")}, ', which was 3 XIDs old when operation ended', LINE_BREAK_,
  {_opt("v % 3 = 0", "'new relfrozenxid: '", _str("event_id + 5"), "', which is 7 XIDs ahead of previous value'")},
  {_opt("v % 5 = 0", "'new relminmxid: '", _str("event_id + 9"), "', which is 2 MXIDs ahead of previous value'")},
  {_opt("v % 2 = 1", "'frozen: '", _str("v % 6"), "' pages from table ('", _str("v % 50"), "'.50% of total) had '", _str("v % 23"), "' tuples frozen'")},
  {_opt("v % 6 < 5", "'index scan '", _SCAN, "': '", _str("v % 13"), "' pages from table ('", _str("v % 40"), "'.75% of total) had '", _str("v % 19"), "' dead item identifiers removed'")},
  {_opt("v % 3 >= 1", _INDEX_LINE.format("ix_a"))},
  {_opt("v % 3 = 2", _INDEX_LINE.format("ix b"))},
  {_opt("v % 7 = 0", "'I/O timings: read: '", _str("v % 30"), "'.500 ms, write: '", _str("v % 20"), "'.250 ms'")},
  {_TAIL},
  'WAL usage: ', {_str("v * 4")}, ' records, ', {_str("v % 11")}, ' full page images, ', {_str("v * 50")}, ' bytes', LINE_BREAK_,
  {_USAGE_LINE})"""
_ANALYZE = f"""CONCAT('automatic analyze of table ', {_TARGET}, LINE_BREAK_,
  {_opt("v % 7 = 1", "'I/O timings: read: '", _str("v % 30"), "'.500 ms, write: '", _str("v % 20"), "'.250 ms'")},
  {_TAIL},
  {_USAGE_LINE})"""
_COMPLETE = f"""CONCAT(CASE WHEN v % 11 = 0 THEN 'restartpoint' ELSE 'checkpoint' END, ' complete: wrote ', {_str("v")}, ' buffers (', {_str("v % 100")}, '.5%); ', {_str("v % 7")}, ' WAL file(s) added, ',
  {_str("v % 5")}, ' removed, ', {_str("v % 3")}, ' recycled; write=', {_str("v % 50")}, '.', {_V3}, ' s, sync=0.', {_V3}, ' s, total=', {_str("v % 60")}, '.', {_V3},
  ' s; sync files=3, longest=0.001 s, average=0.001 s; distance=5 kB, estimate=6 kB; lsn=0/1A, redo lsn=0/1B')"""


def _log(kind: str, level: str, message: str, **fields: str) -> str:
    """Log records of one kind of event.

    The message passes a one-element explode, so that filters on it read a column
    as they would on stored logs and do not rebuild the text.
    """
    absent = {c: "CAST(NULL AS STRING)" for c in ("hint", "context", "user_query")} | {"query_pos": "CAST(NULL AS INT)"}
    extra = ", ".join(f"{v} AS {c}" for c, v in (absent | fields).items() if c != "pid")
    return f"""
SELECT instid, ts AS timestamp, CASE WHEN v % 6 = 0 THEN NULL ELSE CONCAT('u', CAST(user_id % 7 AS STRING)) END AS username,
       CONCAT('db', CAST(dbid AS STRING)) AS database, CAST({fields.get("pid", "user_id")} AS INT) AS pid,
       CASE v % 4 WHEN 0 THEN '[local]' WHEN 1 THEN '10.0.0.1:5000' WHEN 2 THEN 'hosty' ELSE NULL END AS client_addr,
       CONCAT('s', CAST(user_id AS STRING)) AS session_id, event_id AS session_line_num, '{level}' AS elevel,
       CASE kind WHEN 3 THEN '57014' WHEN 1 THEN '00000' ELSE '42P01' END AS sqlstate, EXPLODE_(ARRAY_({message})) AS message, {extra}
FROM x_events WHERE {kind}"""


_FLAGS = "CASE WHEN v % 5 = 0 THEN 'shutdown immediate' WHEN v % 2 = 0 THEN 'time' ELSE 'wal' END"
_DDL = "CONCAT('ddl ', CAST(event_id AS STRING))"
_WORKER = "CAST(100 + user_id % 4 AS STRING)"
F["log"] = " UNION ALL ".join(
    [
        _log("kind = 1", "LOG", f"CONCAT('checkpoint starting: ', {_FLAGS})"),
        _log("kind = 2", "LOG", _COMPLETE),
        _log(
            "kind = 3", "ERROR", "'canceling autovacuum task'", pid="100 + user_id % 4",
            context=f"CONCAT('while scanning block 7', LINE_BREAK_, 'automatic ', CASE WHEN v % 2 = 0 THEN 'vacuum' ELSE 'analyze' END, ' of table ', {_TARGET})",
        ),
        _log("kind = 4", "LOG", _VACUUM, query_pos="CAST(v % 90 AS INT)"),
        _log(
            "kind = 5 AND v % 2 = 0", "LOG", "'agent: autovacuum cancel request'",
            hint=f"CONCAT('sending cancel to blocking autovacuum PID ', {_WORKER})", user_query=_DDL,
        ),
        _log("kind = 5 AND v % 2 <> 0", "LOG", _ANALYZE, user_query=_DDL),
    ]
)
F["x_levels"] = """
SELECT event_id, CASE v % 9 WHEN 0 THEN 'DEBUG' WHEN 1 THEN 'INFO' WHEN 2 THEN 'NOTICE' WHEN 3 THEN 'WARNING' WHEN 4 THEN 'ERROR'
       WHEN 5 THEN 'LOG' WHEN 6 THEN 'FATAL' WHEN 7 THEN 'PANIC' ELSE 'ALERT' END AS elevel,
       CASE kind WHEN 1 THEN '00000' WHEN 2 THEN '42P01' WHEN 3 THEN '57014' WHEN 4 THEN '22012' ELSE '23505' END AS sqlstate,
       CASE WHEN user_id % 5 = 0 THEN NULL ELSE CONCAT('u', CAST(user_id % 7 AS STRING)) END AS username,
       CASE WHEN v % 10 = 0 THEN 'agent: snapshot requested' ELSE CONCAT('m', CAST(v AS STRING)) END AS message
FROM x_events"""
F["x_backends"] = """
SELECT event_id, instid, ts, DATE_TRUNC('hour', ts) AS sampled_at, user_id AS pid, CONCAT('10.0.0.', CAST(user_id % 250 AS STRING)) AS client,
       CASE WHEN v % 10 = 0 THEN 'autovacuum worker' ELSE 'client backend' END AS backend_type, user_id = 7 AS is_sampler,
       CASE WHEN kind = 3 THEN 'Lock' WHEN kind = 1 AND v % 3 = 0 THEN 'IO' END AS wait_event_type,
       CASE kind WHEN 1 THEN 'idle' WHEN 2 THEN 'idle in transaction' WHEN 5 THEN 'disabled' ELSE 'active' END AS state,
       DATE_TRUNC('day', ts) AS xact_start, v % 11 = 0 AS in_vacuum, CONCAT('q', CAST(event_id AS STRING)) AS query
FROM x_events"""
F["x_disk_days"] = """
SELECT instid, event_type, d, CAST(SUM(v) AS BIGINT) AS v FROM x_events GROUP BY instid, event_type, d"""
F["x_disk_before"] = """
SELECT instid AS i, event_type AS e, d AS day,
       COALESCE(SUM(v) OVER (PARTITION BY instid, event_type ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
FROM x_disk_days"""
# totals of the days before, and a running sum inside each day
F["x_disks"] = """
SELECT instid, device, sampled_at, d, event_id, CAST(t AS BIGINT) % 900000 AS rd_sectors, CAST(t * 3 AS BIGINT) % 800000 AS wr_sectors,
       CAST(t AS BIGINT) % 70000 AS rd_ticks, CAST(t * 2 AS BIGINT) % 60000 AS wr_ticks, CAST(t * 5 AS BIGINT) % 50000 AS rq_ticks
FROM (SELECT instid, event_type AS device, ts AS sampled_at, d, event_id, b + SUM(v) OVER (PARTITION BY instid, event_type, d ORDER BY ts, event_id) AS t
      FROM x_events JOIN x_disk_before ON instid = i AND event_type = e AND d = day) s"""
F["x_waits"] = """
SELECT instid, ts AS sampled_at, d, dbid, user_id % 5 AS userid, user_id % 20 AS queryid, 'client backend' AS backend_type,
       CASE WHEN kind < 4 THEN 'IO' ELSE 'Lock' END AS event_type, CASE WHEN kind <> 5 THEN CONCAT('ev', CAST(v % 4 AS STRING)) END AS event
FROM x_events"""
F["x_execs"] = """
SELECT 1 + l_suppkey % 2 AS instid, l_partkey % 97 AS dbid, CAST(l_linenumber AS BIGINT) AS userid, l_partkey AS queryid,
       CASE WHEN l_returnflag = 'R' THEN 'plan' ELSE 'exec' END AS kind, l_linestatus = 'O' AS toplevel,
       CAST(l_quantity AS BIGINT) AS reads, CAST(l_quantity AS BIGINT) * 2 AS writes, l_quantity / 4 AS user_time, l_quantity / 8 AS system_time,
       CAST(l_linenumber AS BIGINT) AS minflts, l_suppkey AS majflts, l_orderkey AS nvcsws, l_partkey AS nivcsws
FROM lineitem"""
F["x_queries"] = """
SELECT 1 + o_custkey % 2 AS instid, o_custkey AS pid, EXTRACT(YEAR FROM o_orderdate) AS xact, o_orderkey AS executed_at,
       CONCAT('UPDATE t SET a = ', CAST(o_orderkey AS STRING), REPEAT('x', CAST(o_orderkey % 140 AS INT)), CASE WHEN o_orderstatus = 'F' THEN ';' ELSE '' END) AS query
FROM orders"""
F["x_statements"] = """
SELECT instid, pid % 53 AS pid, executed_at,
       CASE WHEN executed_at % 11 = 0 THEN 'BEGIN' WHEN executed_at % 13 = 5 THEN 'COMMIT' WHEN executed_at % 29 = 3 THEN 'savepoint s' ELSE query END AS query
FROM x_queries"""

# --- catalogs ----------------------------------------------------------------
F["c_databases"] = """
SELECT snapid, dbid, CONCAT('db', CAST(dbid % 61 AS STRING)) AS datname, n3 < 30 AS datallowconn, instid = 2 AS in_recovery, v AS size,
       CAST(n AS INT) AS age, v AS xact_commit, n3 AS xact_rollback, v * 3 AS blks_fetched, v AS blks_hit, v * 2 AS tup_returned,
       n AS tup_fetched, n4 AS tup_inserted, n1 AS tup_updated, n3 AS tup_deleted, n1 AS confl_tablespace, n2 AS confl_lock,
       n3 AS confl_snapshot, n4 AS confl_bufferpin, n AS confl_deadlock, n1 AS temp_files, v * 5 AS temp_bytes, n3 AS deadlocks,
       CAST(v AS DOUBLE) / 8 AS blk_read_time, CAST(n AS DOUBLE) / 4 AS blk_write_time
FROM x_db"""
F["c_roles"] = """
SELECT DISTINCT snapid, o_userid AS oid, CONCAT('role', CAST(o_userid AS STRING)) AS rolname FROM (SELECT snapid, userid AS o_userid FROM x_orders) r"""
F["c_settings"] = """
SELECT snapid, CONCAT('p', event_type) AS name, CAST(n AS STRING) AS setting, 'ms' AS unit,
       CASE kind WHEN 1 THEN 'client' WHEN 2 THEN 'default' ELSE 'configuration file' END AS source, CAST(n - n % 2 AS STRING) AS boot_val
FROM x_kind"""
F["c_namespaces"] = """
SELECT 1 AS oid, 'public' AS nspname UNION ALL SELECT 2, 'app' UNION ALL SELECT 3, 'pg_toast'"""
F["c_relations"] = """
SELECT p_partkey AS oid, 1 + p_partkey % 3 AS relnamespace, 0 AS reltablespace, p_name AS relname,
       CASE WHEN p_size < 25 THEN p_partkey + 1 ELSE 0 END AS reltoastrelid, CASE p_type WHEN 'ECONOMY' THEN 'i' WHEN 'STANDARD' THEN 't' ELSE 'r' END AS relkind,
       p_size AS relpages, CAST(p_size * 10 AS FLOAT) AS reltuples, CASE WHEN p_size > 30 THEN ARRAY_('fillfactor=70') END AS reloptions,
       p_partkey * 100 AS size, p_partkey AS numscans, p_partkey * 2 AS tuples_returned, p_partkey * 3 AS tuples_fetched,
       p_partkey AS n_tup_ins, p_partkey AS n_tup_upd, p_partkey AS n_tup_del, p_partkey AS n_tup_hot_upd, p_partkey AS n_live_tup,
       p_partkey AS n_dead_tup, p_partkey AS n_mod_since_analyze, p_partkey * 9 AS blks_fetched, p_partkey * 5 AS blks_hit,
       CAST(NULL AS TIMESTAMP) AS last_vacuum, CAST(NULL AS TIMESTAMP) AS last_autovacuum, CAST(NULL AS TIMESTAMP) AS last_analyze,
       CAST(NULL AS TIMESTAMP) AS last_autoanalyze, CAST(403 AS BIGINT) AS relam
FROM part"""
F["c_indexes"] = """
SELECT 1000000000 + l_partkey * 10 + l_linenumber AS indexrelid, l_partkey AS indrelid, SUM(CAST(l_quantity AS BIGINT)) > 100 AS indisvalid,
       l_linenumber = 1 AS indisprimary, l_linenumber < 3 AS indisunique, l_linenumber = 2 AS indisclustered,
       ARRAY_(CAST(1 AS SMALLINT), CAST(2 AS SMALLINT)) AS indkey, 'CREATE INDEX i ON t USING btree (a)' AS indexdef,
       COUNT(*) AS numscans, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tuples_returned,
       CAST(SUM(CAST(l_quantity AS BIGINT)) * 2 AS BIGINT) AS tuples_fetched, COUNT(*) * 9 AS blks_fetched, COUNT(*) * 4 AS blks_hit
FROM lineitem GROUP BY l_partkey, l_linenumber"""
F["c_attributes"] = """
SELECT l_partkey AS attrelid, CAST(l_linenumber AS SMALLINT) AS attnum, CONCAT('c', CAST(l_linenumber AS STRING)) AS attname,
       'integer' AS type, -1 AS attstattarget, 'p' AS attstorage, COUNT(*) > 3 AS attnotnull, FALSE AS attisdropped
FROM lineitem GROUP BY l_partkey, l_linenumber"""
F["c_statistics"] = """
SELECT starelid, staattnum, q % 3 = 1 AS stainherit, CAST(4 + q % 60 AS INT) AS stawidth, CAST(q AS FLOAT) AS stadistinct,
       CASE WHEN q % 4 = 0 THEN 3 ELSE 1 END AS stakind1, CASE WHEN q % 5 = 0 THEN 3 ELSE 2 END AS stakind2,
       CASE WHEN q % 7 = 0 THEN 3 ELSE 2 END AS stakind3, CASE WHEN q % 2 = 0 THEN 3 ELSE 2 END AS stakind4,
       ARRAY_(CAST(CAST(q % 100 AS DOUBLE) / 128 AS FLOAT)) AS stanumbers1, ARRAY_(CAST(CAST(q % 90 AS DOUBLE) / 128 AS FLOAT)) AS stanumbers2,
       ARRAY_(CAST(CAST(q % 80 AS DOUBLE) / 128 AS FLOAT)) AS stanumbers3, ARRAY_(CAST(CAST(q % 70 AS DOUBLE) / 128 AS FLOAT)) AS stanumbers4
FROM (SELECT l_partkey AS starelid, CAST(l_linenumber AS SMALLINT) AS staattnum, SUM(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) END) AS q
      FROM lineitem GROUP BY l_partkey, l_linenumber) g"""
F["c_locks"] = """
SELECT snapid * 100000 + user_id AS pid, ARRAY_(snapid * 100000 + user_id + 1, snapid * 100000 + user_id + 2) AS blocking_pids,
       CASE WHEN kind = 4 THEN snapid * 100000 + user_id END AS transactionid,
       1 + v % 500 AS relation, ts AS waitstart, kind = 1 AS granted
FROM x_events"""
F["c_activity"] = """
SELECT snapid * 100000 + user_id AS pid, MAX(dbid) AS datid, MAX(CONCAT('app', CAST(event_id AS STRING))) AS application_name, '10.0.0.1' AS client_addr,
       CAST(NULL AS STRING) AS client_hostname, CAST(5000 AS INT) AS client_port, 'Lock' AS wait_event_type, 'relation' AS wait_event,
       MAX(CONCAT('upd ', CAST(event_id AS STRING))) AS query
FROM x_events WHERE kind <> 5 GROUP BY snapid, user_id"""
F["c_last"] = """
SELECT snapid * 100000 + user_id AS pid, MAX(CONCAT('last ', CAST(event_id AS STRING))) AS queries FROM x_events WHERE kind <> 2 GROUP BY snapid, user_id"""
F["c_prepared"] = """
SELECT snapid * 100000 + user_id AS transaction, MIN(CASE WHEN kind = 4 AND v > 5000 THEN CONCAT('gid', CAST(event_id AS STRING)) END) AS gid
FROM x_events GROUP BY snapid, user_id"""

# --- scope of the checked reports ------------------------------------------
F["o_scope"] = """
SELECT snapid, instid, time FROM snapshot WHERE instid = 1 AND snapid BETWEEN 9 AND 49"""
F["o_step"] = """
SELECT snapid, time, MICROS_(time) - MICROS_(LAG(time) OVER (ORDER BY snapid)) AS us FROM o_scope"""
F["o_pair"] = """
SELECT MIN(CASE WHEN snapid = 9 THEN time END) AS t1, MIN(CASE WHEN snapid = 49 THEN time END) AS t2 FROM snapshot"""

# --- statements --------------------------------------------------------------
F["statement"] = """
SELECT snapid, dbid, userid, queryid, CONCAT('select ', CAST(queryid AS STRING)) AS query, CAST(FLOOR(n / 4) AS BIGINT) AS plans,
       CAST(n AS DOUBLE) / 4 AS total_plan_time, n * 3 AS calls, CAST(p AS DOUBLE) / 8 AS total_exec_time,
       CAST(p AS DOUBLE) / 16 AS shared_blk_read_time, CAST(n AS DOUBLE) AS shared_blk_write_time,
       CAST(n AS DOUBLE) / 2 AS local_blk_read_time, CAST(p AS DOUBLE) / 4 AS local_blk_write_time,
       CAST(n AS DOUBLE) / 8 AS temp_blk_read_time, CAST(p AS DOUBLE) / 2 AS temp_blk_write_time
FROM x_stmt"""
F["plan"] = """
SELECT snapid, dbid, userid, queryid, planid, 'plan' AS plan, n * 3 AS calls, CAST(p AS DOUBLE) / 8 AS total_time,
       CAST(p AS DOUBLE) / 16 AS shared_blk_read_time, CAST(n AS DOUBLE) AS shared_blk_write_time,
       CAST(n AS DOUBLE) / 2 AS local_blk_read_time, CAST(p AS DOUBLE) / 4 AS local_blk_write_time,
       CAST(n AS DOUBLE) / 8 AS temp_blk_read_time, CAST(p AS DOUBLE) / 2 AS temp_blk_write_time,
       FROM_MICROS_(1704067200000000 + queryid * 1500000) AS first_call,
       FROM_MICROS_(1704067200000000 + d * 86400000000 + queryid * 1500000) AS last_call
FROM x_plan"""
F["function"] = """
SELECT snapid, dbid, queryid AS funcid, CAST(1 + queryid % 3 AS BIGINT) AS nsp, CONCAT('fn', CAST(queryid AS STRING)) AS funcname,
       '' AS argtypes, n AS calls, CAST(p AS DOUBLE) / 8 AS total_time, CAST(p AS DOUBLE) / 16 AS self_time
FROM x_stmt"""
F["wait_sampling"] = """
SELECT snapid, dbid, userid, queryid, backend_type, event_type, event,
       CAST(SUM(n) OVER (PARTITION BY instid, dbid, userid, queryid, backend_type, event_type, event ORDER BY d) AS BIGINT) AS count
FROM (SELECT d, instid, snapid, dbid, userid, queryid, o_orderstatus AS backend_type, o_orderpriority AS event_type,
             CONCAT('ev', CAST(p % 4 AS STRING)) AS event, CAST(SUM(1 + p % 7) AS BIGINT) AS n
      FROM x_orders GROUP BY d, instid, snapid, dbid, userid, queryid, o_orderstatus, o_orderpriority, p % 4) g"""


def _needs(sql: str) -> list[str]:
    """Frames a statement reads (names after FROM or JOIN)."""
    found = re.findall(r"(?:FROM|JOIN)\s+\"?([a-z_]\w*)\"?", sql)
    return [name for name in dict.fromkeys(found) if name in F]


def _ordered(sql: str) -> list[str]:
    """Frames behind ``sql``, each after the ones it reads."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name not in done:
            for inner in _needs(F[name]):
                visit(inner)
            done.append(name)

    for name in _needs(sql):
        visit(name)
    return done


def _translate(sql: str, dialect: dict[str, str]) -> str:
    # longer tokens first, so FROM_MICROS_( is not read as MICROS_(
    for token in sorted(dialect, key=len, reverse=True):
        sql = sql.replace(token, dialect[token])
    return sql




def duckdb_sql(sql: str) -> str:
    """Statement for DuckDB with the frames it reads as common table expressions."""
    names = _ordered(sql)
    body = ",\n".join(f'"{n}" AS ({_quote(F[n], '"')})' for n in names)
    head = f"WITH {body}\n" if names else ""
    if sql.lstrip().upper().startswith("WITH "):
        sql = sql.lstrip()[5:]
        head = f"WITH {body},\n" if names else "WITH "
    return _translate(head + sql, DUCKDB)


def _quote(sql: str, mark: str) -> str:
    """Quote column aliases that a dialect may reserve."""
    return re.sub(
        r"\bAS (table|index|column|start|timestamp|time|transaction|setting|name|size)\b", rf"AS {mark}\1{mark}", sql
    )


def spark_frame(spark: SparkSession, sf_dir: str, name: str, built: dict[str, DataFrame]) -> DataFrame:
    """Frame over the frames it reads; ``built`` keeps each analysed plan once."""
    if name not in built:
        inner = {n: spark_frame(spark, sf_dir, n, built) for n in _needs(F[name])}
        text = _quote(_translate(F[name], SPARK), "`")
        for n in inner:
            text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
        for base in BASE_TABLES:
            text = re.sub(rf"\b(FROM|JOIN) {base}\b", rf"\1 parquet.`{sf_dir}/{base}.parquet`", text)
        built[name] = spark.sql(text, **inner)
    return built[name]


class DerivedRepository(Repository):
    """Repository whose tables are derived on demand from the test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__(spark)
        self.sf_dir = sf_dir
        self._built: dict[str, DataFrame] = {}

    def _open(self, name: str) -> DataFrame:
        if name in F:
            frame = spark_frame(self.spark, self.sf_dir, name, self._built)
            wanted = schemas.struct(name) if name in schemas.DDL else []
            missing = [f for f in wanted if f.name not in frame.columns]
            return frame.withColumns({f.name: _null(f) for f in missing}) if missing else frame
        return super()._open(name)


def _null(field):
    from pyspark.sql import functions as fn

    return fn.lit(None).cast(field.dataType)
