"""CSV log reading, routing and the streaming jobs against their batch twins."""

import csv
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import Repository, schemas
from tidemark.sources import logfile
from tidemark.streaming import events, jobs, logs

FIELDS = schemas.column_names("log")[1:]
T0 = datetime(2024, 3, 1, 12, 0, 0)
COMPLETE = (
    "checkpoint complete: wrote 42 buffers (0.3%); 1 WAL file(s) added, 2 removed, 3 recycled; "
    "write=1.250 s, sync=0.004 s, total=1.300 s; sync files=3, longest=0.001 s, average=0.001 s; "
    "distance=5 kB, estimate=6 kB; lsn=0/1A, redo lsn=0/1B"
)
USAGE = "system usage: CPU: user: 0.01 s, system: 0.02 s, elapsed: 2.50 s"
RATES = (
    "avg read rate: 1.500 MB/s, avg write rate: 0.250 MB/s\n"
    "buffer usage: 10 hits, 2 misses, 1 dirtied\n"
)


def vacuum(indexes: int, kind: str = "needed") -> str:
    lines = "".join(
        f'index "ix{i}": pages: {5 + i} in total, 1 newly deleted, 2 currently deleted, 3 reusable\n' for i in range(indexes)
    )
    return (
        'automatic vacuum of table "db.public.t": index scans: 1\n'
        "pages: 0 removed, 9 remain, 9 scanned (100.00% of total)\n"
        "tuples: 3 removed, 4 remain, 5 are dead but not yet removable\n"
        "removable cutoff: 700, which was 3 XIDs old when operation ended\n"
        "new relfrozenxid: 650, which is 7 XIDs ahead of previous value\n"
        f"index scan {kind}: 2 pages from table (22.22% of total) had 6 dead item identifiers removed\n"
        f"{lines}{RATES}"
        "WAL usage: 8 records, 1 full page images, 900 bytes\n" + USAGE
    )


def record(seconds, **fields):
    base = dict.fromkeys(FIELDS, "")
    at = T0 + timedelta(seconds=seconds)
    base.update(timestamp=at.strftime("%Y-%m-%d %H:%M:%S.123 UTC"), pid="7", elevel="LOG", session_line_num=str(seconds))
    return base | fields


RECORDS = [
    record(0, message="checkpoint starting: time", username="u,1", detail='say "hi"\nthere'),
    record(5, message=COMPLETE),
    record(6, message=COMPLETE),  # no start: dropped
    record(10, message="checkpoint starting: shutdown immediate"),
    record(11, message=COMPLETE),
    record(20, message="checkpoint starting: wal"),
    record(21, message="checkpoint starting: immediate force wait"),
    record(25, message=COMPLETE),
    record(30, message=vacuum(0)),
    record(31, message=vacuum(1)),
    record(32, message=vacuum(2, "bypassed by failsafe")),
    record(33, message=vacuum(0, "of unknown kind")),
    record(40, message='automatic analyze of table "db.public.t"\nI/O timings: read: 1.500 ms, write: 0.500 ms\n' + RATES + USAGE),
    record(50, message="agent: autovacuum cancel request", hint="sending cancel to blocking autovacuum PID 77", user_query="LOCK TABLE t"),
    record(60, message="canceling autovacuum task", elevel="ERROR", pid="77", context='x\nautomatic vacuum of table "db.public.t"'),
    record(70, message="canceling autovacuum task", elevel="ERROR", pid="77", context='automatic analyze of table "db.public.t"'),
    record(80, message="agent: snapshot requested"),
    record(90, message="relation missing", elevel="ERROR", sqlstate="42P01", username="web"),
    record(95, message="note", elevel="DEBUG2", username="noise"),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two finished log files of instance 3; the second ends with a short record."""
    path = tmp_path_factory.mktemp("csv") / "instid=3"
    path.mkdir()
    for name, rows in (("a.csv", RECORDS[:9]), ("b.csv", RECORDS[9:])):
        with open(path / name, "w", newline="") as f:
            writer = csv.writer(f, quoting=csv.QUOTE_MINIMAL, lineterminator="\n")
            writer.writerows([[r[c] for c in FIELDS] for r in rows])
            if name == "b.csv":
                f.write("broken,record\n")
    return str(path)


@pytest.fixture(scope="module")
def log(spark, folder):
    return logfile.read_csvlog(spark, folder).cache()


def test_csv_mapping(log):
    assert log.count() == len(RECORDS)
    first = log.where("session_line_num = 0").first()
    assert (first["instid"], first["username"], first["detail"]) == (3, "u,1", 'say "hi"\nthere')
    assert first["timestamp"] == T0 + timedelta(milliseconds=123)
    assert first["hint"] is None
    assert log.where("elevel = 'DEBUG'").count() == 1


def test_checkpoints(log):
    got = events.checkpoint_events(log).orderBy("start").collect()
    assert [r["flags"] for r in got] == ["time", "immediate force wait"]
    assert (got[0]["num_buffers"], got[0]["xlog_added"], got[0]["xlog_recycled"]) == (42, 1, 3)
    assert round(got[0]["total_duration"], 3) == 1.3
    assert got[0]["start"] == T0 + timedelta(milliseconds=123)


def test_vacuum_and_analyze(log):
    got = events.autovacuum_events(log).orderBy("start").collect()
    assert [r["index_names"] for r in got] == [[], ["ix0"], ["ix0", "ix1"]]
    assert [r["index_scan_ptn"] for r in got] == [2, 2, 4]
    assert got[2]["index_pages_total"] == [5, 6]
    assert (got[0]["new_relfrozenxid"], got[0]["new_relminmxid"], got[0]["tup_miss_dead"]) == (650, None, None)
    assert got[0]["start"] == T0 + timedelta(seconds=27, milliseconds=623)
    analyze = events.autoanalyze_events(log).collect()
    assert [(r["table"], r["page_hit"], r["io_timings_read"]) for r in analyze] == [("t", 10, 1.5)]


def test_cancel_uses_a_request_once(log):
    got = {r["work"]: r["query"] for r in events.cancel_events(log).collect()}
    assert got == {"vacuum": "LOCK TABLE t", "analyze": None}


def test_cancel_request_expires(spark, folder):
    late = logfile.read_csvlog(spark, folder).withColumn(
        "timestamp", F.when(F.col("session_line_num") == 60, F.expr("timestamp + INTERVAL 5 MINUTE")).otherwise(F.col("timestamp"))
    )
    got = {r["work"]: r["query"] for r in events.cancel_events(late.where("session_line_num <> 70")).collect()}
    assert got == {"vacuum": None}


def test_levels():
    ranked = [m for m in ("DEBUG", "ERROR", "LOG", "FATAL")]
    assert [logs.LEVELS.index(m) for m in ranked] == sorted(logs.LEVELS.index(m) for m in ranked)


def test_routing(log):
    route = logs.Route("error", hidden_users=["web"], adjust={"LOG": ["42P01"]})
    kept = {r["session_line_num"] for r in logs.routed(log, route).collect()}
    assert {80, 50, 90, 95}.isdisjoint(kept)  # control messages, hidden user, low level
    assert 60 in kept and 0 in kept


def test_text_line(log):
    line = log.where("session_line_num = 0").select(logs.format_log_line("%u %p: ").alias("l")).first()["l"]
    assert line == 'u,1 7: LOG:  checkpoint starting: time\nu,1 7: DETAIL:  say "hi"\n\tthere'


def _store(spark, folder, tmp_path):
    root, ck = str(tmp_path / "repo"), tmp_path / "ck"
    stream = lambda: logfile.stream_csvlog(spark, folder, files_per_trigger=1)
    for name, start in (
        ("log", lambda: jobs.store_log(stream(), root, str(ck / "log"), logs.Route("ERROR"), once=True)),
        ("va", lambda: jobs.store_vacuum_and_analyze(stream(), root, str(ck / "va"), once=True)),
        ("cp", lambda: jobs.store_checkpoints(stream(), root, str(ck / "cp"), once=True)),
        ("cn", lambda: jobs.store_cancels(stream(), root, str(ck / "cn"), once=True)),
    ):
        query = start()
        assert query.awaitTermination(120), name
        assert query.exception() is None
    return Repository(spark, path=root)


def test_streams_match_batch(spark, folder, log, tmp_path):
    stored = _store(spark, folder, tmp_path)
    for table, batch in (
        ("checkpoint", events.checkpoint_events(log)),
        ("autovacuum", events.autovacuum_events(log)),
        ("autoanalyze", events.autoanalyze_events(log)),
        ("autovacuum_cancel", events.autovacuum_cancels(events.cancel_events(log))),
        ("autoanalyze_cancel", events.autoanalyze_cancels(events.cancel_events(log))),
    ):
        got, want = stored.table(table), batch.select(*stored.table(table).columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), table
    kept = logs.routed(log, logs.Route("ERROR"))
    assert stored.table("log").count() == kept.count()


def test_one_stream_to_several_sinks(spark, folder, tmp_path):
    out = {n: str(tmp_path / n) for n in ("errors", "everything")}
    query = jobs.route_logs(
        logfile.stream_csvlog(spark, folder),
        str(tmp_path / "ck"),
        {n: (logs.Route(m), jobs.text_sink(out[n], "%t ", logs.DEFAULT)) for n, m in (("errors", "FATAL"), ("everything", "DEBUG"))},
        once=True,
    )
    assert query.awaitTermination(120)
    assert spark.read.text(out["errors"]).count() == 0
    assert spark.read.text(out["everything"]).where("value LIKE '%relation missing'").count() == 1


@pytest.fixture
def pieces_of(spark):
    """Cut files into pieces of so many bytes; the settings are put back."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    kept = [spark.conf.get(n) for n in names]

    def cut(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield cut
    for n, v in zip(names, kept):
        spark.conf.set(n, v)


def same_rows(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("size", [61, 333, 1 << 20])
def test_large_files_are_read_in_pieces(spark, tmp_path, pieces_of, size):
    texts = ['say "hi"\nthere', "\n\n\n", '"', '""\n"', "a,b", "line\n\n" * 9, "'", 'x\n"broken,record\n', " \t"]
    path = tmp_path / "instid=4"
    path.mkdir()
    for name, n in (("a.csv", 9), ("b.csv", 1), ("c.csv", 4)):
        with open(path / name, "w", newline="") as f:
            writer = csv.writer(f, lineterminator="\n")
            for i in range(n):
                row = record(i, message=texts[i % len(texts)], detail=texts[(i * 5 + 2) % len(texts)], username="u")
                writer.writerow([row[c] for c in FIELDS])
                f.write("broken,record\n" if i % 3 == 1 else "\n" if i % 4 == 2 else "")
    (path / "empty.csv").write_text("")
    whole = logfile.read_csvlog(spark, str(path))
    assert whole.count() == 14
    whole = whole.collect()
    pieces_of(size)
    got = logfile.read_large_csvlog(spark, str(path))
    assert got.columns == schemas.column_names("log")
    assert sorted(map(str, got.collect())) == sorted(map(str, whole))
    assert got.select("pid").count() == 14 and got.where("message LIKE '%broken%'").count() == sum("broken" in (r.message or "") for r in whole)


def test_pieces_equal_whole_files(spark, folder, log, pieces_of):
    pieces_of(200)
    assert logfile.read_large_csvlog(spark, folder).rdd.getNumPartitions() > 1
    assert same_rows(logfile.read_large_csvlog(spark, folder), log)
    assert same_rows(logfile.read_large_csvlog(spark, folder, 9).select("instid").distinct(), spark.sql("SELECT 9L AS instid"))
