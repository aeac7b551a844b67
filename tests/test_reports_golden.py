"""Report results on the recorded fixture."""

from datetime import datetime
from decimal import Decimal

import pytest

from tests.fixture import ROWS, build
from tidemark.plans import databases, instance, maintenance, relations, replication, resources, statements, waits

B, E = 1, 4


def rows(df):
    return [tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in df.collect()]


def one(df):
    got = df.collect()
    assert len(got) == 1
    return {k: float(v) if isinstance(v, Decimal) else v for k, v in got[0].asDict().items()}


def test_summary(repo):
    got = one(databases.summary(repo, B, E))
    assert got["total_dbsize"] == "26 MiB"
    assert (got["total_commits"], got["total_rollbacks"], got["duration"]) == (66970, 0, 180)
    assert got["snap_end"] == datetime(2012, 11, 1, 0, 3)


def test_dbstats(repo):
    got = one(databases.dbstats(repo, B, E))
    assert got["datname"] == "postgres"
    assert (got["size"], got["size_incr"]) == (26, 3)
    assert got["xact_commit_tps"] == 372.056
    assert (got["blks_hit_rate"], got["blks_hit_tps"], got["blks_read_tps"]) == (100.0, 10394.122, 3.333)
    assert got["tup_fetch_tps"] == 5709.183
    assert (got["temp_files"], got["temp_bytes"], got["deadlocks"]) == (1, 8, 1)
    assert got["blk_read_time"] == 3337.718


def test_xact_and_size_tendency(repo):
    assert [r[2] for r in rows(databases.xact_tendency(repo, B, E))] == [371.517, 373.100, 371.550]
    assert [r[2] for r in rows(databases.dbsize_tendency(repo, B, E))] == [22.435, 23.646, 24.841, 26.099]


def test_db_rusage(repo):
    assert rows(databases.db_rusage(repo, B, E)) == [("postgres", 9, 9, 0.9, 0.9, 18, 18, 1.8, 1.8)]


def test_recovery_conflicts(repo):
    assert rows(databases.recovery_conflicts(repo, B, E)) == [("postgres", 1, 2, 3, 4, 5)]


def test_wal(repo):
    assert [r[3:5] for r in rows(instance.wal_tendency(repo, B, E))] == [(12.504, 0.208), (26.722, 0.445), (13.173, 0.220)]
    got = one(instance.wal_stats(repo, B, E))
    assert (got["write_total"], got["write_speed"]) == (52.399, 0.291)
    assert (got["archive_total"], got["archive_failed"]) == (4, 1)
    assert rows(instance.stat_wal(repo, B, E))[0][:5] == (824540, 479, 64638470.0, 1876, 1950)
    assert [r[1] for r in rows(instance.stat_wal2(repo, B, E))] == [None, 478, 1, 0]


def test_processes(repo):
    got = rows(instance.proc_tendency(repo, B, E))
    assert [r[1] for r in got] == [2, 40, 20, 40]
    assert [r[5] for r in got] == [0, 10, 5, 10]
    last = rows(instance.proc_tendency_with_average(repo, B, E))[-1]
    assert last == ("Average", 25.5, "(36.4 %)", 12.8, "(18.2 %)", 6.3, "(9.1 %)", 25.5, "(36.4 %)")
    assert rows(instance.proc_ratio(repo, B, E)) == [(36.4, 18.2, 9.1, 36.4)]


def test_bgwriter_and_xid(repo):
    got = one(instance.bgwriter_stats(repo, B, E))
    assert (got["bgwriter_write_avg"], got["bgwriter_write_max"]) == (20.0, 30.0)
    assert (got["backend_write_avg"], got["backend_write_max"]) == (200.0, 300.0)
    assert (got["backend_fsync_avg"], got["backend_fsync_max"]) == (2.0, 3.0)
    assert [r[1] for r in rows(instance.xid_tendency(repo, B, E))] == [None, 21636, 15, 4]
    assert [r[1] for r in rows(instance.xid_tendency(repo, 2, E))] == [21636, 15, 4]


def test_os_resources(repo):
    got = rows(resources.cpu_loadavg_with_average(repo, B, E))
    assert got[0][1:] == (37.7, 14.7, 0.1, 47.5, 0.940, 0.390, 0.690)
    assert got[1][1:5] == (30.9, 12.1, 0.0, 57.0)
    assert got[-1] == ("Average", 33.7, 13.0, 0.1, 53.2, 1.153, 0.563, 0.733)
    usage = one(resources.io_usage(repo, B, E))
    assert usage["device_tblspaces"] == ["pg_default", "pg_global"]
    assert (usage["total_read"], usage["total_write"], usage["total_read_time"]) == (0, 665, 11317)
    assert (usage["total_write_time"], usage["io_queue"], usage["total_io_time"]) == (6701892, 11.667, 6713205)
    assert [r[2:] for r in rows(resources.io_usage_tendency(repo, B, E))] == [
        (2.47, 3536.13, 17.1, 1539.3, 200.0, 4000.0),
        (0.0, 4215.33, 0.0, 7177.7, 0.0, 5000.0),
        (0.13, 3599.47, 1.7, 2452.9, 100.0, 3000.0),
    ]
    assert rows(resources.memory_tendency(repo, B, E))[1][1:] == (150.07, 25.53, 640.96, 65.86, 0.03)


def test_notable_tables(repo):
    updated = rows(relations.heavily_updated_tables(repo, B, E))
    assert [(r[2], r[6], r[7]) for r in updated] == [
        ("pgbench_branches", 66535, 100.0),
        ("pgbench_tellers", 66534, 100.0),
        ("pgbench_history", 66533, 0.0),
        ("pgbench_accounts", 66533, 97.8),
    ]
    accessed = rows(relations.heavily_accessed_tables(repo, B, E))
    assert [r[2:] for r in accessed] == [
        ("pgbench_tellers", 81067, 665330, 8.207, 100.0),
        ("pgbench_branches", 109143, 66533, 0.610, 100.0),
    ]
    assert [r[2:] for r in rows(relations.low_density_tables(repo, B, E))] == [
        ("pgbench_accounts", 100002, 1640, 1700, 96.5)
    ]
    assert [r[2:] for r in rows(relations.correlation(repo, B, E))] == [
        ("pgbench_tellers", "tid", -0.357),
        ("pgbench_accounts", "aid", 0.951),
    ]


def test_schema_information(repo):
    indexes = rows(relations.schema_info_indexes(repo, B, E))
    assert [(r[2], r[-1]) for r in indexes] == [
        ("pgbench_accounts_pkey", "aid"), ("pgbench_branches_pkey", "bid"), ("pgbench_tellers_pkey", "tid")
    ]
    assert indexes[0][4:8] == (2, 0, 133066, 1.0)
    assert [(r[2], r[3]) for r in rows(relations.schema_info_tables(repo, B, E))] == [
        ("pgbench_accounts", 4), ("pgbench_branches", 2), ("pgbench_history", None), ("pgbench_tellers", 2)
    ]


def test_events(repo):
    assert rows(maintenance.checkpoint_activity(repo, B, E)) == [(2, 1, 1, 2343.5, 2404.0, 47.445, 49.193)]
    assert [r[0] for r in rows(maintenance.long_transactions(repo, B, E))] == [10593, 10592, 10591, 10590]


def test_waits_and_statements(repo):
    expected = [("IO", "DataFileRead", 14, 66.667, 1), ("Client", "ClientRead", 7, 33.333, 2)]
    assert rows(waits.wait_sampling_by_instance(repo, B, E)) == expected
    assert [r[2:] for r in rows(waits.wait_sampling_by_database(repo, B, E))] == expected
    assert [r[6:10] for r in rows(waits.wait_sampling(repo, B, E))] == [r[:4] for r in expected]
    got = one(statements.query_statements(repo, B, E))
    assert (got["calls"], got["total_exec_time"], got["time_per_call"]) == (300, 7.5, 0.025)
    usage = rows(statements.query_statements_rusage(repo, B, E))
    assert usage == [("postgres", "postgres", "SELECT 1", 3, 3, 0.3, 0.3, 6, 6, 0.6, 0.6)]


def test_replication(repo):
    got = one(replication.replication_activity(repo, B, E))
    assert got["replay_delay_peak"] == 0x206D8
    assert got["snapshot_time"] == datetime(2012, 11, 1, 0, 3)
    status = one(replication.replication_status(repo, B, E))
    assert status["replay_delay_peak"] == "130 KiB"
    assert status["replay_lag_time"] == "00:00:12.000000"


@pytest.mark.parametrize("report", [databases.dbstats, databases.xact_tendency, resources.io_usage_tendency])
def test_equal_times_give_zero_rates(spark, report):
    frozen = dict(ROWS, snapshot=[{**r, "time": ROWS["snapshot"][0]["time"]} for r in ROWS["snapshot"]])
    got = report(build(spark, frozen), B, E).collect()
    assert got
    for row in got:
        for name, value in row.asDict().items():
            if name.endswith("_tps") and "peak" not in name:
                assert value == 0
