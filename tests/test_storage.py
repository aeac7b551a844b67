"""Stored layout: exact pruning, time zones, replayed batches, guarded rewrites, several writers, compaction."""

import glob
import threading
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark import Repository, schemas, versions
from tidemark.plans import common, databases, relations
from tidemark.sources import retention, sink
from tidemark.streaming import jobs

START = datetime(2024, 3, 1, 23, 30, tzinfo=timezone.utc)


def facts(spark, n):
    return {
        "database": spark.createDataFrame([(1, "db", n, 0, 100)], "dbid long, name string, xact_commit long, xact_rollback long, size long"),
        "activity": spark.createDataFrame([(1, 2, 3, 4, 5)], "idle int, idle_in_xact int, waiting int, running int, max_backends int"),
    }


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """Six days; server 1 writes snapshots 1, 3, 5, ..., servers 2 and 3 take turns in between."""
    root = str(tmp_path_factory.mktemp("layout") / "repo")
    instance = spark.createDataFrame([(i, "s", "h", 5432 + i) for i in (1, 2, 3)], "instid long, name string, hostname string, port int")
    sink.append_dimension(instance, root, "instance")
    for day in range(6):
        for instid in (1, 2 + day % 2):
            sink.append_snapshot(spark, root, instid, START + timedelta(days=day), facts(spark, 10 * day), rules={})
    return root


def scanned(df):
    """(partitions, files) of each file scan that ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "AdaptiveSparkPlan" in name:
            todo.append(node.executedPlan())
        if "QueryStage" in name:
            todo.append(node.plan())
        if name.startswith("Scan parquet"):
            metric = {k: node.metrics().apply(k).value() for k in ("numPartitions", "numFiles") if node.metrics().contains(k)}
            if "numPartitions" in metric:
                found.append((metric["numPartitions"], metric["numFiles"]))
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_a_pair_opens_two_folders(spark, root):
    repo = Repository(spark, path=root)
    df = repo.at("database", 1, 11)
    assert df.count() == 2
    assert scanned(df) == [(2, 2)]


def test_a_range_opens_its_servers_folders(spark, root):
    repo = Repository(spark, path=root)
    df = repo.ranged("database", 1, 7)
    assert scanned(df) == [(4, 4)]
    assert sorted(r.snapid for r in df.collect()) == [1, 3, 5, 7]
    assert repo.scoped("database", 1, 7).count() == 4
    assert common.in_scope(repo, "activity", 1, 7).count() == 4
    assert sorted(r.snapid for r in repo.between("database", 1, 7).collect()) == list(range(1, 8))


def test_rows_of_other_servers_in_one_bucket_stay_out(spark, tmp_path):
    root = str(tmp_path / "r")
    for instid in (1, 1 + 128, 1):
        sink.append_snapshot(spark, root, instid, START, facts(spark, 5), rules={})
    repo = Repository(spark, path=root)
    assert sorted(r.snapid for r in repo.ranged("database", 1, 3).collect()) == [1, 2, 3]
    assert sorted(r.snapid for r in repo.scoped("database", 1, 3).collect()) == [1, 3]


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/Los_Angeles"])
def test_other_time_zones_read_the_same_rows(spark, root, zone):
    repo = Repository(spark, path=root)
    want = [databases.dbstats(repo, 1, 11).collect(), repo.at("database", 1).count(), repo.scoped("activity", 1, 11).count()]
    log = spark.createDataFrame([(1, START, "e"), (1, START + timedelta(hours=1), "f")], "instid long, timestamp timestamp, elevel string")
    sink.append_events(log, f"{root}-{zone[:4]}", "log")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        repo = Repository(spark, path=root)
        assert [databases.dbstats(repo, 1, 11).collect(), repo.at("database", 1).count(), repo.scoped("activity", 1, 11).count()] == want
        sink.append_events(log, f"{root}-{zone[:4]}", "log", "again")
        days = Repository(spark, path=f"{root}-{zone[:4]}")._stored("log").groupBy("date").count().collect()
        assert sorted((str(r.date), r["count"]) for r in days) == [("2024-03-01", 2), ("2024-03-02", 2)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def vacuums(spark):
    return spark.createDataFrame([(1, START, "d", "s", f"t{i}") for i in range(3)], "instid long, start timestamp, database string, schema string, table string")


def test_a_replayed_batch_is_stored_once(spark, tmp_path, monkeypatch):
    """The second of two appends fails; the batch comes again, and once more."""
    root, calls = str(tmp_path / "r"), []
    monkeypatch.setattr(jobs.events, "autovacuum_events", lambda df: vacuums(spark))
    monkeypatch.setattr(jobs.events, "autoanalyze_events", lambda df: vacuums(spark).limit(2))
    monkeypatch.setattr(jobs, "_start", lambda df, ck, deliver, once: calls.append(deliver))
    jobs.store_vacuum_and_analyze(None, root, "/ck/")
    whole = jobs.append_events

    def broken(df, root, table, batch):
        if table == "autoanalyze":
            raise OSError("lost")
        whole(df, root, table, batch)

    monkeypatch.setattr(jobs, "append_events", broken)
    checkpoints = [tmp_path / n for n in ("ck", "other")]
    for i, c in enumerate(checkpoints):
        c.mkdir()
        (c / "metadata").write_text(f'{{"id":"stream-{i}"}}')
    here, other = map(str, checkpoints)
    name = jobs.batch_name(spark, here + "/", 7)
    assert name == jobs.batch_name(spark, here, 7) != jobs.batch_name(spark, here, 8) and name != jobs.batch_name(spark, other, 7)
    (checkpoints[1] / "metadata").write_text('{"id":"stream-9"}')  # made anew at the same place
    assert "stream-9" in jobs.batch_name(spark, other, 7)
    with pytest.raises(RuntimeError):
        jobs.batch_name(spark, str(tmp_path / "none"), 0)
    with pytest.raises(OSError):
        calls[0](vacuums(spark), name)
    monkeypatch.setattr(jobs, "append_events", whole)
    for _ in range(2):
        calls[0](vacuums(spark), name)
    calls[0](vacuums(spark), jobs.batch_name(spark, here, 8))
    repo = Repository(spark, path=root)
    assert (repo.table("autovacuum").count(), repo.table("autoanalyze").count()) == (6, 4)
    assert repo.table("autovacuum").columns == schemas.column_names("autovacuum")


def test_writers_never_share_an_id(spark, tmp_path):
    root, got = str(tmp_path / "r"), []
    threads = [threading.Thread(target=lambda: got.extend(sink.claim_snapshot(spark, root) for _ in range(8))) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == list(range(1, 33))


def test_claims_do_not_pile_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sink, "CLAIMS_KEPT", 3)
    root = str(tmp_path / "r")
    assert [sink.claim_snapshot(spark, root) for _ in range(9)] == list(range(1, 10))
    assert len([f for f in glob.glob(f"{root}/{sink.CLAIMS}/*")]) <= 5


def listed(spark, root):
    return sorted(r.snapid for r in Repository(spark, path=root).table("snapshot").collect())


def test_a_row_appended_during_a_rewrite_stays(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "r")
    for _ in range(2):
        sink.append_snapshot(spark, root, 1, START, facts(spark, 1), rules={})
    commit, done = versions.commit, []

    def late(spark_, root_, table, gone=(), added=()):
        if gone and table == "snapshot" and not done:  # the copy is written, the exchange comes next
            done.append(sink.append_snapshot(spark, root, 1, START, facts(spark, 7), rules={}).snapid)
        return commit(spark_, root_, table, gone, added)

    monkeypatch.setattr(versions, "commit", late)
    retention.del_snapshot(spark, root, 1)
    assert done == [3] and listed(spark, root) == [2, 3]
    assert sorted(r.snapid for r in Repository(spark, path=root).table("database").collect()) == [2, 3]


def test_a_reader_keeps_its_version_and_a_dead_rewrite_is_invisible(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "r")
    for _ in range(3):
        sink.append_snapshot(spark, root, 1, START, facts(spark, 1), rules={})
    before = Repository(spark, path=root)
    frames = [before.table(t) for t in ("snapshot", "database")]

    def dying(*_, **__):
        raise OSError("died")

    with monkeypatch.context() as m:
        m.setattr(versions, "commit", dying)
        with pytest.raises(OSError):
            retention.del_snapshot(spark, root, 2)
    assert listed(spark, root) == [1, 2, 3]  # the staged copy does not show
    retention.del_snapshot(spark, root, 2)
    retention.compact(spark, root, "snapshot", START.date())
    assert [f.count() for f in frames] == [3, 3] and listed(spark, root) == [1, 3]
    removed = versions.vacuum(spark, root, "snapshot", grace=0)
    assert len(removed) == 5  # three rows, the dead copy, the copy before the compaction
    assert listed(spark, root) == [1, 3] and versions.vacuum(spark, root, "snapshot", grace=0) == []
    assert sink.append_snapshot(spark, root, 1, START, facts(spark, 1), rules={}).snapid == 4
    retention.del_snapshot(spark, root, 1)
    assert listed(spark, root) == [3, 4]
    assert versions.names(spark, f"{root}/{versions.LOG}/snapshot")[0].endswith(".all")


def test_writer_rewrites_and_reader_at_once(spark, tmp_path):
    """Nothing is lost or shown twice while one thread appends, two delete and compact and one reads."""
    root, failed, done = str(tmp_path / "r"), [], threading.Event()
    for _ in range(6):
        sink.append_snapshot(spark, root, 1, START, facts(spark, 1), rules={})

    def guarded(work):
        def run():
            try:
                work()
            except Exception as e:  # noqa: BLE001
                failed.append(e)

        return run

    def write():
        for _ in range(4):
            sink.append_snapshot(spark, root, 1, START, facts(spark, 1), rules={})

    def delete():
        for snapid in (1, 3, 5):
            retention.del_snapshot(spark, root, snapid)

    def gather():
        for _ in range(3):
            retention.compact(spark, root, "snapshot", START.date())

    def look():
        while not done.is_set():
            for table in ("snapshot", "database"):
                ids = sorted(r.snapid for r in Repository(spark, path=root).table(table).select("snapid").collect())
                assert len(ids) == len(set(ids)) and {2, 4, 6} <= set(ids), (table, ids)

    reader = threading.Thread(target=guarded(look))
    threads = [threading.Thread(target=guarded(w)) for w in (write, delete, gather)]
    for t in [reader, *threads]:
        t.start()
    for t in threads:
        t.join()
    done.set()
    reader.join()
    assert not failed, failed
    assert listed(spark, root) == [2, 4, 6, 7, 8, 9, 10]
    assert sorted(r.snapid for r in Repository(spark, path=root).table("database").collect()) == [2, 4, 6, 7, 8, 9, 10]


def test_commits_of_several_writers_all_hold(spark, tmp_path):
    root = str(tmp_path / "r")

    def work(i):
        for k in range(5):
            assert versions.commit(spark, root, "database", added=[f"c-{i}-{k}"])

    threads = [threading.Thread(target=work, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    version = versions.current(spark, root, "database")
    assert version.number == 20 and len(version.added) == 20
    assert versions.commit(spark, root, "database", gone=["batch=x"]) and not versions.commit(spark, root, "database", gone=["batch=x", "batch=y"])


def test_size_of_a_snapshot_is_that_of_its_own_files(spark, tmp_path, monkeypatch):
    root, bytes_of = str(tmp_path / "r"), sink._bytes
    first = sink.append_snapshot(spark, root, 1, START, facts(spark, 1), rules={})

    def beside(spark_, folders):  # another server of the bucket writes just before the sum
        if not root_busy:
            root_busy.append(1)
            sink.append_fact(sink.stamped(facts(spark, 1)["database"], 99), root, "database", F.lit(START.date()), 1 + 128, "s-99")
        return bytes_of(spark_, folders)

    root_busy = []
    monkeypatch.setattr(sink, "_bytes", beside)
    sink.append_snapshot(spark, root, 1, START, facts(spark, 1), rules={})
    sizes = [r.snapshot_increase_size for r in Repository(spark, path=root).table("snapshot").orderBy("snapid").collect()]
    assert first.snapid == 1 and sizes[0] > 0 and abs(sizes[0] - sizes[1]) < 100  # not one file more


def test_compaction_keeps_rows_and_pruning(spark, tmp_path):
    root = str(tmp_path / "r")
    for i in range(6):
        sink.append_snapshot(spark, root, 1 + i % 2, START, facts(spark, i), rules={})
        sink.append_events(vacuums(spark), root, "autovacuum", f"b-{i}")
    before = sorted(map(str, Repository(spark, path=root).table("database").collect()))
    monkey = retention.FILES
    retention.FILES = 1
    try:
        day = (START + timedelta(days=1)).date()
        assert retention.compact(spark, root, "database", START.date()) == []
        assert len(retention.compact(spark, root, "database", day)) == 2
        assert len(retention.compact(spark, root, "autovacuum", day)) == 1
        assert retention.compact(spark, root, "snapshot", day) == ["snapshot"]
    finally:
        retention.FILES = monkey
    repo = Repository(spark, path=root)
    assert sorted(map(str, repo.table("database").collect())) == before and repo.table("autovacuum").count() == 18
    assert len(versions.live(spark, root, "database")) == 2 and repo.table("snapshot").count() == 6
    assert scanned(repo.at("database", 1, 3)) == [(1, 1)]


def test_reports_on_stored_tables(spark, root):
    repo = Repository(spark, path=root)
    assert databases.dbstats(repo, 1, 11).count() == 1
    assert relations.setting_parameters(repo, 1, 11).count() == 0
    got = repo.bounds(1, 11)
    row = spark.range(1).select(got.instid.alias("i"), F.date_format(got.start, "dd").alias("s"), F.date_format(got.end, "dd").alias("e")).first()
    assert tuple(row) == (1, "01", "06")
