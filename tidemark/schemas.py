"""Column layout of every repository table.

Fixed values: table names, column names and column order are the data model
that agents and report users already know.  Intervals are stored as bigint
microseconds, unsigned 32-bit ids as bigint, WAL positions as text.
"""

from __future__ import annotations

from pyspark.sql import types as T

_IO_TIMES = (
    "shared_blk_read_time double, shared_blk_write_time double, local_blk_read_time double, "
    "local_blk_write_time double, temp_blk_read_time double, temp_blk_write_time double"
)
_BLOCKS = (
    "rows bigint, shared_blks_hit bigint, shared_blks_read bigint, shared_blks_dirtied bigint, "
    "shared_blks_written bigint, local_blks_hit bigint, local_blks_read bigint, local_blks_dirtied bigint, "
    "local_blks_written bigint, temp_blks_read bigint, temp_blks_written bigint"
)


def _usage(kind: str) -> str:
    counters = "reads bigint, writes bigint, user_time double, system_time double, minflts bigint, majflts bigint, nvcsws bigint, nivcsws bigint"
    return ", ".join(f"{kind}_{c}" for c in counters.split(", "))


DDL: dict[str, str] = {
    # dimensions
    "instance": "instid bigint, name string, hostname string, port int, pg_version string, xlog_file_size bigint, page_size int, page_header_size smallint, htup_header_size smallint, item_id_size smallint",
    "snapshot": "snapid bigint, instid bigint, time timestamp, comment string, exec_time bigint, snapshot_increase_size bigint, xid_current decimal(20,0)",
    # per-snapshot facts
    "tablespace": "snapid bigint, tbs bigint, name string, location string, device string, avail bigint, total bigint, spcoptions array<string>",
    "database": "snapid bigint, dbid bigint, name string, size bigint, age int, xact_commit bigint, xact_rollback bigint, blks_read bigint, blks_hit bigint, tup_returned bigint, tup_fetched bigint, tup_inserted bigint, tup_updated bigint, tup_deleted bigint, confl_tablespace bigint, confl_lock bigint, confl_snapshot bigint, confl_bufferpin bigint, confl_deadlock bigint, temp_files bigint, temp_bytes bigint, deadlocks bigint, blk_read_time double, blk_write_time double",
    "schema": "snapid bigint, dbid bigint, nsp bigint, name string",
    "table": "snapid bigint, dbid bigint, tbl bigint, nsp bigint, date date, tbs bigint, name string, toastrelid bigint, toastidxid bigint, relkind string, relpages int, reltuples float, reloptions array<string>, size bigint, seq_scan bigint, seq_tup_read bigint, idx_scan bigint, idx_tup_fetch bigint, n_tup_ins bigint, n_tup_upd bigint, n_tup_del bigint, n_tup_hot_upd bigint, n_live_tup bigint, n_dead_tup bigint, n_mod_since_analyze bigint, heap_blks_read bigint, heap_blks_hit bigint, idx_blks_read bigint, idx_blks_hit bigint, toast_blks_read bigint, toast_blks_hit bigint, tidx_blks_read bigint, tidx_blks_hit bigint, last_vacuum timestamp, last_autovacuum timestamp, last_analyze timestamp, last_autoanalyze timestamp",
    "index": "snapid bigint, dbid bigint, idx bigint, tbl bigint, date date, tbs bigint, name string, relam bigint, relpages int, reltuples float, reloptions array<string>, isunique boolean, isprimary boolean, isclustered boolean, isvalid boolean, indkey array<smallint>, indexdef string, size bigint, idx_scan bigint, idx_tup_read bigint, idx_tup_fetch bigint, idx_blks_read bigint, idx_blks_hit bigint",
    "column": "snapid bigint, dbid bigint, tbl bigint, attnum smallint, date date, name string, type string, stattarget int, storage string, isnotnull boolean, isdropped boolean, avg_width int, n_distinct float, correlation float",
    "activity": "snapid bigint, idle int, idle_in_xact int, waiting int, running int, max_backends int",
    "xact": "snapid bigint, client string, pid int, start timestamp, duration double, query string",
    "setting": "snapid bigint, name string, setting string, unit string, source string",
    "role": "snapid bigint, userid bigint, name string",
    "inherits": "snapid bigint, dbid bigint, inhrelid bigint, inhparent bigint, inhseqno int",
    "statement": f"snapid bigint, dbid bigint, userid bigint, queryid bigint, query string, plans bigint, total_plan_time double, calls bigint, total_exec_time double, {_BLOCKS}, {_IO_TIMES}",
    "plan": f"snapid bigint, dbid bigint, userid bigint, queryid bigint, planid bigint, plan string, calls bigint, total_time double, {_BLOCKS}, {_IO_TIMES}, first_call timestamp, last_call timestamp",
    "function": "snapid bigint, dbid bigint, funcid bigint, nsp bigint, funcname string, argtypes string, calls bigint, total_time double, self_time double",
    "cpu": "snapid bigint, cpu_id string, cpu_user bigint, cpu_system bigint, cpu_idle bigint, cpu_iowait bigint, overflow_user smallint, overflow_system smallint, overflow_idle smallint, overflow_iowait smallint",
    "device": "snapid bigint, device_major string, device_minor string, device_name string, device_readsector bigint, device_readtime bigint, device_writesector bigint, device_writetime bigint, device_ioqueue bigint, device_iototaltime bigint, device_rsps_max double, device_wsps_max double, overflow_drs smallint, overflow_drt smallint, overflow_dws smallint, overflow_dwt smallint, overflow_dit smallint, device_tblspaces array<string>",
    "loadavg": "snapid bigint, loadavg1 float, loadavg5 float, loadavg15 float",
    "memory": "snapid bigint, memfree bigint, buffers bigint, cached bigint, swap bigint, dirty bigint",
    "wait_sampling": "snapid bigint, dbid bigint, userid bigint, queryid bigint, backend_type string, event_type string, event string, count bigint",
    "profile": "snapid bigint, processing string, execute bigint, total_exec_time double",
    "lock": "snapid bigint, dbid bigint, nspname string, relname string, blocker_appname string, blocker_addr string, blocker_hostname string, blocker_port int, blockee_pid int, blocker_pid int, blocker_gid string, wait_event_type string, wait_event string, duration bigint, blockee_query string, blocker_query string",
    "bgwriter": "snapid bigint, buffers_clean bigint, maxwritten_clean bigint, buffers_alloc bigint",
    "replication": "snapid bigint, procpid int, usesysid bigint, usename string, application_name string, client_addr string, client_hostname string, client_port int, backend_start timestamp, backend_xmin bigint, state string, current_location string, sent_location string, write_location string, flush_location string, replay_location string, write_lag bigint, flush_lag bigint, replay_lag bigint, sync_priority int, sync_state string",
    "replication_slots": "snapid bigint, slot_name string, plugin string, slot_type string, datoid bigint, temporary boolean, active boolean, active_pid int, xact_xmin bigint, catalog_xmin bigint, restart_lsn string, confirmed_flush_lsn string, inactive_since timestamp, invalidation_reason string",
    "stat_replication_slots": "snapid bigint, slot_name string, spill_txns bigint, spill_count bigint, spill_bytes bigint, stream_txns bigint, stream_count bigint, stream_bytes bigint, total_txns bigint, total_bytes bigint, stats_reset timestamp",
    "stat_io": "snapid bigint, backend_type string, object string, context string, reads bigint, read_time double, writes bigint, write_time double, writebacks bigint, writeback_time double, extends bigint, extend_time double, op_bytes bigint, hits bigint, evictions bigint, reuses bigint, fsyncs bigint, fsync_time double, stats_reset timestamp",
    "stat_wal": "snapid bigint, wal_records bigint, wal_fpi bigint, wal_bytes decimal(30,0), wal_buffers_full bigint, wal_write bigint, wal_sync bigint, wal_write_time double, wal_sync_time double, stats_reset timestamp",
    "publication": "snapid bigint, dbid bigint, pubid bigint, pubname string, pubowner bigint, puballtables boolean, pubinsert boolean, pubupdate boolean, pubdelete boolean",
    "publication_tables": "snapid bigint, dbid bigint, pubname string, schemaname string, tablename string",
    "subscription": "snapid bigint, subid bigint, subdbid bigint, subname string, subowner bigint, subenabled boolean, subconninfo string, subslotname string, subsynccommit string, subpublications array<string>",
    "stat_subscription": "snapid bigint, subid bigint, subname string, pid int, relid bigint, received_lsn string, last_msg_send_time timestamp, last_msg_receipt_time timestamp, latest_end_lsn string, latest_end_time timestamp",
    "xlog": "snapid bigint, location string, xlogfile string",
    "alert_message": "snapid bigint, message string",
    "alert_state": "snapid bigint, instid bigint, kind string, dbid bigint, userid bigint, same string, n1 bigint, n2 bigint, x double",
    "archive": "snapid bigint, archived_count bigint, last_archived_wal string, last_archived_time timestamp, failed_count bigint, last_failed_wal string, last_failed_time timestamp, stats_reset timestamp",
    "rusage": f"snapid bigint, dbid bigint, userid bigint, queryid bigint, {_usage('plan')}, {_usage('exec')}",
    "ht_info": "snapid bigint, statements_dealloc bigint, statements_reset timestamp, wait_sampling_dealloc bigint, wait_sampling_reset timestamp, rusage_dealloc bigint, rusage_reset timestamp",
    # events
    "autovacuum": "instid bigint, start timestamp, database string, schema string, table string, index_scans int, page_removed bigint, page_remain bigint, tbl_scan_pages bigint, tbl_scan_pages_ratio double, tup_removed bigint, tup_remain bigint, tup_dead bigint, removable_cutoff decimal(20,0), read_rate double, write_rate double, page_hit bigint, page_miss bigint, page_dirty bigint, wal_records bigint, wal_page_images bigint, wal_bytes bigint, duration float, tup_miss_dead bigint, tup_miss_dead_pages bigint, new_relfrozenxid decimal(20,0), new_relminmxid decimal(20,0), frozen_pages bigint, frozen_pages_ratio double, frozen_tuples bigint, index_scan_ptn int, dead_lp_pages bigint, dead_lp_pages_ratio double, dead_lp bigint, index_names array<string>, index_pages_total array<bigint>, index_pages_new_del array<bigint>, index_pages_current_del array<bigint>, index_pages_reusable array<bigint>, io_timings_read double, io_timings_write double",
    "autoanalyze": "instid bigint, start timestamp, database string, schema string, table string, page_hit bigint, page_miss bigint, page_dirty bigint, read_rate double, write_rate double, duration float, io_timings_read double, io_timings_write double",
    "autovacuum_cancel": "instid bigint, timestamp timestamp, database string, schema string, table string, query string",
    "autoanalyze_cancel": "instid bigint, timestamp timestamp, database string, schema string, table string, query string",
    "checkpoint": "instid bigint, start timestamp, flags string, num_buffers bigint, xlog_added bigint, xlog_removed bigint, xlog_recycled bigint, write_duration float, sync_duration float, total_duration float",
    "log": "instid bigint, timestamp timestamp, username string, database string, pid int, client_addr string, session_id string, session_line_num bigint, ps_display string, session_start timestamp, vxid string, xid bigint, elevel string, sqlstate string, message string, detail string, hint string, query string, query_pos int, context string, user_query string, user_query_pos int, location string, application_name string, backend_type string, leader_pid int, query_id bigint",
    # change-only facts
    "cpuinfo": "instid bigint, timestamp timestamp, vendor_id string, model_name string, cpu_mhz float, processors int, threads_per_core int, cores_per_socket int, sockets int",
    "meminfo": "instid bigint, timestamp timestamp, mem_total bigint",
    # configuration
    "alert": "instid bigint, rollback_tps bigint, commit_tps bigint, garbage_size bigint, garbage_percent int, garbage_percent_table int, response_avg bigint, response_worst bigint, backend_max int, correlation_percent int, disk_remain_percent int, loadavg_1min float, loadavg_5min float, loadavg_15min float, swap_size int, rep_flush_delay int, rep_replay_delay int, enable_alert boolean",
}

# Thresholds a newly registered instance starts with.
DEFAULT_THRESHOLDS: dict[str, object] = {
    "rollback_tps": 100,
    "commit_tps": 1000,
    "garbage_size": -1,
    "garbage_percent": 30,
    "garbage_percent_table": 30,
    "response_avg": 10,
    "response_worst": 60,
    "backend_max": 100,
    "correlation_percent": 70,
    "disk_remain_percent": 20,
    "loadavg_1min": 7.0,
    "loadavg_5min": 6.0,
    "loadavg_15min": 5.0,
    "swap_size": 1000000,
    "rep_flush_delay": 100,
    "rep_replay_delay": 200,
    "enable_alert": True,
}

# Event tables and the column that dates them.
EVENT_TIME = {
    "autovacuum": "start",
    "autoanalyze": "start",
    "autovacuum_cancel": "timestamp",
    "autoanalyze_cancel": "timestamp",
    "checkpoint": "start",
    "log": "timestamp",
}
DIMENSIONS = ("instance", "snapshot", "alert")
CHANGE_ONLY = ("cpuinfo", "meminfo")
# One batch per server, replaced with each of its snapshots: what alert rules need of the snapshot before.
CARRIED = ("alert_state",)
# Tables without folders by day and server.
UNDATED = (*DIMENSIONS, *CHANGE_ONLY, *CARRIED)
# Repository tables whose schema carries the partition date itself.
DATED_FACTS = ("table", "index", "column")


def column_names(name: str) -> list[str]:
    """Columns of a table in order (needs no session)."""
    return [part.split(" ", 1)[0] for part in _columns(DDL[name])]


def struct(name: str) -> T.StructType:
    # StructType.fromDDL needs reserved words quoted
    quoted = []
    for part in _columns(DDL[name]):
        column, kind = part.split(" ", 1)
        quoted.append(f"`{column}` {kind}")
    return T.StructType.fromDDL(", ".join(quoted))


def stored_struct(name: str) -> T.StructType:
    """Columns of a stored table with those of its folders."""
    schema = struct(name)
    if name not in UNDATED:
        if "date" not in schema.names:
            schema = schema.add("date", "date")
        schema = schema.add("server", T.IntegerType())
    return schema.add("batch", T.StringType())


def _columns(ddl: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for ch in ddl:
        depth += ch in "(<"
        depth -= ch in ")>"
        if ch == "," and depth == 0:
            parts.append(current.strip())
            current = ""
        else:
            current += ch
    return parts + [current.strip()]


def snapshot_facts() -> list[str]:
    """Tables keyed by ``snapid`` (everything that is not an event or a dimension)."""
    return [t for t in DDL if t not in EVENT_TIME and t not in UNDATED]
