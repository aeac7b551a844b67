"""Alert texts on known resource and replication figures."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tests.fixture import DB, build
from tests.test_storage import scanned
from tidemark import Repository, schemas
from tidemark.plans import alerts
from tidemark.sources import register, sink

GIB = 1024**3


def fixture(spark, **changes):
    limits = dict(schemas.DEFAULT_THRESHOLDS, instid=1, **changes)
    rows = {
        "instance": [{"instid": 1, "name": "n", "hostname": "h", "port": 1}],
        "snapshot": [
            {"snapid": 1, "instid": 1, "time": datetime(2024, 5, 1, 10, 0)},
            {"snapid": 2, "instid": 1, "time": datetime(2024, 5, 1, 10, 1)},
        ],
        "alert": [limits],
        "tablespace": [{"snapid": 2, "name": "tblspc", "avail": int(1.9 * GIB), "total": 10 * GIB}],
        "loadavg": [{"snapid": 2, "loadavg1": 7.1, "loadavg5": 6.1, "loadavg15": 5.1}],
        "memory": [{"snapid": 2, "swap": 1000001}],
        "replication": [
            {
                "snapid": 2, "client_addr": "192.168.0.1", "client_port": 5555, "current_location": "0/C900000 (x)",
                "flush_location": "0/6400000 (x)", "replay_location": "0/0 (x)",
            }
        ],
        "database": [
            {"snapid": 1, "dbid": DB, "name": "d", "xact_commit": 0, "xact_rollback": 0},
            {"snapid": 2, "dbid": DB, "name": "d", "xact_commit": 60060, "xact_rollback": 6030},
        ],
        "statement": [
            {"snapid": 2, "dbid": DB, "userid": 1, "query": "q1", "calls": 2, "total_exec_time": 30.0},
            {"snapid": 2, "dbid": DB, "userid": 1, "query": "q2", "calls": 1, "total_exec_time": 61.5},
        ],
        "activity": [{"snapid": 2, "max_backends": 101}],
    }
    return build(spark, rows)


def texts(spark, name, **changes):
    repo = fixture(spark, **changes)
    fired = alerts.alerts(repo, 2, 2, rules={name: alerts.RULES[name]})
    return sorted(r["message"] for r in fired.collect())


NOW = "2024-05-01 10:01:00"
SPAN = "'2024-05-01 10:00:00' and '2024-05-01 10:01:00'"


def test_resource(spark):
    assert texts(spark, "resource") == [
        f"free disk space ratio at 'tblspc' fell below threshold in snapshot '{NOW}' --- 19 % (threshold = 20 %)",
        f"load average 15min exceeds threshold in snapshot '{NOW}' --- 5.1 (threshold = 5)",
        f"load average 1min exceeds threshold in snapshot '{NOW}' --- 7.1 (threshold = 7)",
        f"load average 5min exceeds threshold in snapshot '{NOW}' --- 6.1 (threshold = 6)",
        f"memory swap size exceeds threshold in snapshot '{NOW}' --- 1000001 KiB (threshold = 1000000 KiB)",
    ]


def test_replication(spark):
    assert texts(spark, "replication") == [
        f"WAL flush-delay in '192.168.0.1:5555' exceeds threshold in snapshot '{NOW}' --- 101 MiB (threshold = 100 MiB)",
        f"replay-delay in '192.168.0.1:5555' exceeds threshold in snapshot '{NOW}' --- 201 MiB (threshold = 200 MiB)",
    ]


def test_xact_query_activity(spark):
    assert texts(spark, "xact") == [
        f"too many rollbacks in snapshots between {SPAN} --- 100.5 Rollbacks/sec (threshold = 100 Rollbacks/sec)",
        f"too many transactions in snapshots between {SPAN} --- 1001 Transactions/sec (threshold = 1000 Transactions/sec)",
    ]
    assert texts(spark, "query") == [
        f"Query average response time exceeds threshold in snapshots between {SPAN} --- 38.25 sec (threshold = 10 sec)",
        f"Query worst response time exceeds threshold in snapshots between {SPAN} --- 61.50 sec (threshold = 60 sec)",
    ]
    assert texts(spark, "activity") == [f"too many backends in snapshot '{NOW}' --- 101 (threshold = 100)"]


def test_switched_off(spark):
    assert texts(spark, "activity", backend_max=-1) == []
    assert texts(spark, "resource", enable_alert=False) == []


def test_first_snapshot_is_not_judged(spark):
    repo = fixture(spark)
    assert alerts.alert(repo, 1).count() == 0
    assert alerts.alert(repo, 2).count() == 12


FEW = {name: alerts.RULES[name] for name in ("xact", "query", "activity")}


def _stored(spark, root, servers, days):
    """Snapshots of many servers whose transactions and queries break thresholds now and then."""
    incoming = spark.createDataFrame([(f"s{i}", f"h{i}", 1) for i in range(servers)], "name string, hostname string, port int")
    instance = register.register_instances(spark.createDataFrame([], schemas.struct("instance")), sink.conform(incoming, "instance"))
    sink.append_dimension(instance, root, "instance")
    sink.append_dimension(register.with_default_thresholds(spark.createDataFrame([], schemas.struct("alert")), instance), root, "alert")
    start = datetime(2024, 5, 1, tzinfo=timezone.utc)
    for day in range(days):
        for instid in range(1, servers + 1):
            n = (day + 1) * instid
            facts = {
                "database": spark.createDataFrame([(1, "d", 200_000_000 * n * day, 90_000_000 * n), (2, "e", 1, 1)], "dbid long, name string, xact_commit long, xact_rollback long"),
                "statement": spark.createDataFrame([(1, 9, 1, "q", 2 + day, 40.0 * n), (1, 9, 2, None, 1 + day, 900.0 * day), (1, 9, 3, "r" * 9000, 5, 1.0)], "dbid long, userid long, queryid long, query string, calls long, total_exec_time double"),
                "activity": spark.createDataFrame([(90 + 20 * day,)], "max_backends int"),
                "loadavg": spark.createDataFrame([(8.0 * day, 1.0, 1.0)], "loadavg1 double, loadavg5 double, loadavg15 double"),
            }
            sink.append_snapshot(spark, root, instid, start + timedelta(days=day), facts, rules=FEW)
    return Repository(spark, path=root)


def test_one_snapshot_is_judged_from_its_folder_and_the_carried_state(spark, tmp_path):
    root = str(tmp_path / "r")
    repo = _stored(spark, root, servers=2, days=3)
    state = repo.table("alert_state")
    assert sorted(r.snapid for r in state.where("kind = 'seen'").collect()) == [5, 6]  # one a server
    # judged again as a range and from the stored facts of the snapshot before: the same messages
    found = alerts.alerts(repo, 3, 6, FEW).select("snapid", "message").collect()
    for snapid in (3, 4, 5, 6):
        stored = sorted(r.message for r in repo.at("alert_message", snapid).collect())
        assert len(stored) >= 3 and any("Rollbacks" in m or "response" in m for m in stored)
        assert stored == sorted(r.message for r in found if r.snapid == snapid)
    assert sorted(r.message for r in alerts.alerts(repo, 6, 6, FEW).collect()) == stored
    # the next snapshot of server 2: its facts come from one folder, the values before from one batch
    row = sink._snapshot_row(spark, 7, 2, repo.table("snapshot").where("snapid = 6").first()["time"], "", None)
    seen = Repository(spark, {"snapshot": Repository(spark, path=root).table("snapshot").unionByName(row)}, path=root)
    assert alerts.state_after(seen, 2, 6) is not None and alerts.state_after(seen, 2, 4) is None
    for name in ("database", "statement", "activity"):
        sink.append_fact(sink.stamped(repo.at(name, 6), 7), root, name, F.lit("2024-05-03").cast("date"), 2, "s-7")
    folders = [p for p, _ in scanned(alerts.alerts(seen, 7, 7, FEW))]
    assert folders and max(folders) <= 1
    assert "r" * 100 not in str(alerts.state_after(seen, 2, 6).collect())


def test_query_rule_moves_no_texts(repo):
    plan = alerts.alerts(repo, 2, 4, rules={"query": alerts.rule_query})._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("query#" in line for line in joins)
