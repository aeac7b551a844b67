"""Four snapshots, one minute apart, of one benchmark server.

Fixed values: recorded counters whose report results are known.  Rows are lists of
(column = value) so that absent columns stay NULL.
"""

from __future__ import annotations

import tempfile
from datetime import datetime, timedelta
from decimal import Decimal

from tidemark import Repository, schemas

T0 = datetime(2012, 11, 1)
DB = 12870


def at(seconds: int) -> datetime:
    return T0 + timedelta(seconds=seconds)


def series(**columns):
    """One row per snapshot 1..4 from per-column lists (scalars repeat)."""
    return [
        {"snapid": i + 1, **{k: (v[i] if isinstance(v, list) and len(v) == 4 else v) for k, v in columns.items()}}
        for i in range(4)
    ]


def rows_of(columns: str, *tuples):
    names = columns.split()
    return [dict(zip(names, t, strict=True)) for t in tuples]


ROWS: dict[str, list[dict]] = {}
ROWS["instance"] = rows_of(
    "instid name hostname port pg_version xlog_file_size page_size page_header_size htup_header_size item_id_size",
    (1, "5807946214009601530", "host-a", 5432, "14.0", 0xFF000000, 8192, 24, 24, 4),
)
ROWS["snapshot"] = series(
    instid=1,
    time=[at(0), at(60), at(120), at(180)],
    comment="",
    exec_time=1_000_000,
    snapshot_increase_size=[270336, 8192, 0, 16384],
    xid_current=[Decimal(871), Decimal(22507), Decimal(22522), Decimal(22526)],
)
ROWS["database"] = series(
    dbid=DB,
    name="postgres",
    size=[23524472, 24794232, 26047608, 27366520],
    xact_commit=[13530, 35821, 58207, 80500],
    xact_rollback=0,
    blks_read=[7668, 7953, 8107, 8268],
    blks_hit=[260459, 864774, 1495879, 2130801],
    tup_returned=[282319, 579585, 876280, 1172439],
    tup_fetched=[29532, 76351, 121788, 167065],
    confl_tablespace=[0, 0, 0, 1],
    confl_lock=[0, 0, 0, 2],
    confl_snapshot=[0, 0, 0, 3],
    confl_bufferpin=[0, 0, 0, 4],
    confl_deadlock=[0, 0, 0, 5],
    temp_files=[0, 0, 0, 1],
    temp_bytes=[0, 0, 0, 8388608],
    deadlocks=[0, 0, 0, 1],
    blk_read_time=[109.473, 3447.191, 3447.191, 3447.191],
    blk_write_time=0.0,
)
ROWS["schema"] = series(dbid=DB, nsp=2200, name="public")
ROWS["role"] = series(userid=10, name="postgres")
ROWS["activity"] = series(
    idle=[240, 480, 240, 480],
    idle_in_xact=[120, 240, 120, 240],
    waiting=[60, 120, 60, 120],
    running=[240, 480, 240, 480],
    max_backends=[55, 110, 55, 110],
)
ROWS["archive"] = series(
    archived_count=[0, 1, 3, 4],
    last_archived_wal=[None, "000000010000000000000002", "000000010000000000000004", "000000010000000000000005"],
    failed_count=[0, 0, 1, 1],
)
ROWS["xlog"] = series(
    location=["0/2EFAF90", "0/3B7C140", "0/5635000", "0/63614A8"],
    xlogfile=[f"00000001000000000000000{n}" for n in (2, 3, 5, 6)],
)
ROWS["stat_wal"] = series(
    wal_records=[4320, 218663, 827323, 828860],
    wal_fpi=[504, 982, 983, 983],
    wal_bytes=[Decimal(4451688), Decimal(24563492), Decimal(68873779), Decimal(69090158)],
    wal_buffers_full=[0, 338, 1876, 1876],
    wal_write=[146, 521, 2085, 2096],
    wal_sync=0,
    wal_write_time=0.0,
    wal_sync_time=0.0,
    stats_reset=at(0),
)
ROWS["bgwriter"] = series(
    buffers_clean=[0, 600, 2400, 3600], maxwritten_clean=[0, 6, 24, 36], buffers_alloc=[0, 60000, 240000, 360000]
)
ROWS["stat_io"] = series(
    backend_type="client backend",
    object="relation",
    context="normal",
    writes=[0, 6000, 24000, 36000],
    fsyncs=[0, 60, 240, 360],
)
ROWS["cpu"] = series(
    cpu_id="cpu",
    cpu_user=[22824761, 22826769, 22828472, 22830385],
    cpu_system=[8286073, 8286859, 8287524, 8288247],
    cpu_idle=[1813481527, 1813481531, 1813481533, 1813481536],
    cpu_iowait=[24928112, 24930644, 24933783, 24937040],
    overflow_user=0,
    overflow_system=0,
    overflow_idle=0,
    overflow_iowait=0,
)
ROWS["loadavg"] = series(
    loadavg1=[0.51, 0.94, 1.32, 1.20], loadavg5=[0.20, 0.39, 0.60, 0.70], loadavg15=[0.66, 0.69, 0.74, 0.77]
)
ROWS["memory"] = series(
    memfree=[163992, 153676, 149148, 143180],
    buffers=[25980, 26144, 26288, 26436],
    cached=[651476, 656348, 659236, 662056],
    swap=67440,
    dirty=[184, 28, 5328, 592],
)
ROWS["device"] = series(
    device_major="253",
    device_minor="2",
    device_name="dm-2",
    device_readsector=[221572802, 221573098, 221573098, 221573114],
    device_readtime=[37740555, 37750828, 37750828, 37751872],
    device_writesector=[4256657192, 4257081528, 4257587368, 4258019304],
    device_writetime=[240757474, 241681044, 245987644, 247459366],
    device_ioqueue=[0, 33, 0, 2],
    device_iototaltime=[278506145, 279451174, 283746582, 285219350],
    device_rsps_max=[0.0, 400.0, 0.0, 200.0],
    device_wsps_max=[0.0, 8000.0, 10000.0, 6000.0],
    overflow_drs=0,
    overflow_drt=0,
    overflow_dws=0,
    overflow_dwt=0,
    overflow_dit=0,
)
for row in ROWS["device"]:
    row["device_tblspaces"] = ["pg_default", "pg_global"]

_TABLES = (
    "snapid tbl name relpages reltuples size seq_scan seq_tup_read idx_scan n_tup_ins n_tup_upd n_tup_del "
    "n_tup_hot_upd n_live_tup n_dead_tup n_mod_since_analyze heap_blks_read heap_blks_hit idx_blks_read idx_blks_hit"
)
ROWS["table"] = [
    {**row, "dbid": DB, "nsp": 2200, "relkind": "r", "toastrelid": 0, "reloptions": ["fillfactor=100"]}
    for row in rows_of(
        _TABLES,
        (1, 16419, "pgbench_tellers", 1, 10.0, 49152, 16837, 138210, 0, 10, 13820, 0, 13800, 10, 395, 10, 15, 38352, 3, 22),
        (1, 16425, "pgbench_history", 0, 0.0, 737280, 0, 0, None, 13820, 0, 0, 0, 13820, 0, 20, 91, 13993, None, None),
        (1, 16422, "pgbench_accounts", 1640, 100000.0, 13688832, 1, 100000, 27640, 100000, 13820, 0, 12059, 100000, 3404, 30, 6638, 50282, 551, 58704),
        (1, 16416, "pgbench_branches", 1, 1.0, 40960, 22600, 13822, 0, 1, 13820, 0, 13813, 1, 391, 40, 14, 101117, 3, 9),
        (4, 16422, "pgbench_accounts", 1688, 100002.0, 13926400, 1, 100000, 160706, 100000, 80353, 0, 77145, 100002, 4873, 10000, 6668, 260410, 551, 328518),
        (4, 16425, "pgbench_history", 412, 64164.0, 4243456, 0, 0, None, 80353, 0, 0, 0, 80338, 0, 20000, 520, 82202, None, None),
        (4, 16419, "pgbench_tellers", 6, 10.0, 49152, 97904, 803540, 0, 10, 80354, 0, 80333, 10, 474, 30000, 15, 552040, 3, 25),
        (4, 16416, "pgbench_branches", 7, 1.0, 57344, 131743, 80355, 0, 1, 80355, 0, 80329, 1, 270, 40000, 16, 895948, 3, 38),
    )
]
ROWS["column"] = [
    {"snapid": 4, "dbid": DB, **row}
    for row in rows_of(
        "tbl attnum name avg_width correlation",
        (16416, 1, "bid", 4, None),
        (16416, 2, "bbalance", 4, None),
        (16419, 1, "tid", 4, -0.357143015),
        (16419, 3, "tbalance", 4, -0.214286),
        (16422, 1, "aid", 4, 0.951070011),
        (16422, 2, "bid", 4, 1.0),
        (16422, 3, "abalance", 4, 0.272940993),
        (16422, 4, "filler", 85, 1.0),
    )
]
_KEY_DEF = "CREATE UNIQUE INDEX {0}_pkey ON {0} USING btree ({1})"
ROWS["index"] = [
    {
        "snapid": s, "dbid": DB, "idx": idx, "tbl": tbl, "name": f"{name}_pkey", "isclustered": False,
        "indkey": [1], "indexdef": _KEY_DEF.format(name, key), "size": size, "idx_scan": scans,
        "idx_tup_fetch": fetched, "idx_blks_read": read, "idx_blks_hit": hit,
    }
    for s, idx, tbl, name, key, size, scans, fetched, read, hit in (
        (1, 16429, 16416, "pgbench_branches", "bid", 16384, 0, 0, 3, 9),
        (1, 16431, 16419, "pgbench_tellers", "tid", 16384, 0, 0, 3, 22),
        (1, 16433, 16422, "pgbench_accounts", "aid", 2260992, 27640, 27640, 551, 58704),
        (4, 16429, 16416, "pgbench_branches", "bid", 16384, 0, 0, 3, 38),
        (4, 16431, 16419, "pgbench_tellers", "tid", 16384, 0, 0, 3, 25),
        (4, 16433, 16422, "pgbench_accounts", "aid", 2260992, 160706, 160706, 551, 328518),
    )
]
ROWS["checkpoint"] = rows_of(
    "instid start flags num_buffers total_duration",
    (1, at(30), "wal", 2283, 45.6969986),
    (1, at(90), "time", 2404, 49.1930008),
)
ROWS["xact"] = [
    {"snapid": i + 1, "client": "127.0.0.1", "pid": 10590 + i, "start": at(60 * i - 30 if i else 0),
     "duration": float(i + 1), "query": f"SELECT {i + 1}"}
    for i in range(4)
]
ROWS["rusage"] = [
    {
        "snapid": s, "dbid": DB, "userid": 10, "queryid": q,
        "plan_reads": s, "plan_writes": s, "plan_user_time": s / 10, "plan_system_time": s / 10,
        "exec_reads": 2 * s, "exec_writes": 2 * s, "exec_user_time": 2 * s / 10, "exec_system_time": 2 * s / 10,
    }
    for s in (1, 2, 3, 4)
    for q in (101, 102, 103)
]
ROWS["wait_sampling"] = [
    {
        "snapid": s, "dbid": DB, "userid": 10, "queryid": 101, "backend_type": "client backend",
        "event_type": kind, "event": event, "count": base * 2 ** (s - 1),
    }
    for s in (1, 2, 3, 4)
    for kind, event, base in (("IO", "DataFileRead", 2), ("Client", "ClientRead", 1))
]
ROWS["replication"] = series(
    procpid=14171,
    usename="postgres",
    application_name="walreceiver",
    client_addr="127.0.0.1",
    client_port=58145,
    backend_start=at(0),
    state="streaming",
    current_location=[f"0/{x} (f)" for x in ("30206D8", "45E6680", "5402F60", "685E818")],
    flush_location=[f"0/{x} (f)" for x in ("3000000", "45E6680", "5400DE8", "685E578")],
    replay_location=[f"0/{x} (f)" for x in ("3000000", "45E63A0", "5400DE8", "685E578")],
    write_lag=[1_000_000, 4_000_000, 7_000_000, 10_000_000],
    flush_lag=[2_000_000, 5_000_000, 8_000_000, 11_000_000],
    replay_lag=[3_000_000, 6_000_000, 9_000_000, 12_000_000],
    sync_priority=0,
    sync_state="async",
)
ROWS["statement"] = [
    {
        "snapid": s, "dbid": DB, "userid": 10, "queryid": 101, "query": "SELECT 1", "plans": 0,
        "total_plan_time": 0.0, "calls": 100 * s, "total_exec_time": 2.5 * s,
        **{f"{a}_blk_{o}_time": 1.0 * s for a in ("shared", "local", "temp") for o in ("read", "write")},
    }
    for s in (1, 2, 3, 4)
]


_WRITTEN: dict[int, tuple[list, str]] = {}  # keeps the rows alive, so an id stays theirs


def build(spark, rows=None) -> Repository:
    """Fixture as Parquet-backed frames (each table is written once per test session)."""
    frames = {}
    for name, given in (ROWS if rows is None else rows).items():
        schema = schemas.struct(name)
        if id(given) not in _WRITTEN:
            path = f"{tempfile.mkdtemp(prefix='tidemark-fixture-')}/{name}"
            local = spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in given], schema)
            local.coalesce(1).write.parquet(path)
            _WRITTEN[id(given)] = (given, path)
        frames[name] = spark.read.schema(schema).parquet(_WRITTEN[id(given)][1])
    return Repository(spark, frames)
