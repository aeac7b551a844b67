"""Stored repositories: publishing, pruning, retention, registration, collection."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import Repository, schemas
from tidemark.plans import alerts, catalogue, databases
from tidemark.sources import collect, logfile, register, retention, sink

DAY = datetime(2024, 2, 1, 10, 0)


def database(spark, commits):
    return spark.createDataFrame(
        [(1, "db", commits, 0, 100, 50)], "dbid long, name string, xact_commit long, xact_rollback long, size long, blks_hit long"
    )


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """Five snapshots on three days of one instance, statements of a known and an unknown database."""
    root = str(tmp_path_factory.mktemp("stored") / "repo")
    empty = spark.createDataFrame([], schemas.struct("instance"))
    incoming = spark.createDataFrame([("s", "h", 5432, "17")], "name string, hostname string, port int, pg_version string")
    instance = register.register_instances(empty, sink.conform(incoming, "instance"))
    sink.append_dimension(instance, root, "instance")
    limits = register.with_default_thresholds(spark.createDataFrame([], schemas.struct("alert")), instance)
    sink.append_dimension(limits, root, "alert")
    for i, hours in enumerate((0, 1, 24, 25, 48)):
        statements = spark.createDataFrame([(1, 10, 5, "q", 3, 1.5), (9, 10, 6, "q", 3, 1.5)], "dbid long, userid long, queryid long, query string, calls long, total_exec_time double")
        facts = {
            "database": database(spark, 10_000_000 * i),
            "statement": statements,
            "table": spark.createDataFrame([(1, 7, 2200, "t", 10)], "dbid long, tbl long, nsp long, name string, size long"),
        }
        rules = {"xact": alerts.rule_xact}
        done = sink.append_snapshot(spark, root, 1, DAY + timedelta(hours=hours), facts, xid_current=100 + i, rules=rules, alerts_to_log=True)
        assert done.snapid == i + 1
        assert done.alerts == (1 if hours % 24 == 1 else 0)  # a day apart the rate is low
    return root


def test_published_snapshot(spark, root):
    repo = Repository(spark, path=root)
    got = repo.table("snapshot").orderBy("snapid").collect()
    assert [r["snapid"] for r in got] == [1, 2, 3, 4, 5]
    assert all(r["exec_time"] > 0 and r["snapshot_increase_size"] > 0 for r in got)
    assert repo.table("statement").where("dbid = 9").count() == 0
    assert repo.table("alert_message").count() == 2
    assert repo.table("log").where("elevel = 'ALERT'").count() == 2
    assert {str(r["date"]) for r in repo.table("table").select("date").distinct().collect()} == {"2024-02-01", "2024-02-02", "2024-02-03"}


def test_report_reads_only_the_scopes_days(spark, root):
    repo = Repository(spark, path=root)
    df = databases.dbstats(repo, 1, 2)
    assert float(df.first()["xact_commit_tps"]) == 2777.778
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PartitionFilters: \[[^\n]*\(date#\d+ = [^\n]*ubquery", plan) and "Subquery" in plan
    assert "In(snapid, [1,2])" in plan
    # the whole row group of other snapshots is out of the pushed range too
    assert "ReadSchema" in plan and "tup_updated" not in plan


def test_scopes(spark, root):
    repo = Repository(spark, path=root)
    assert [tuple(r) for r in catalogue.report_scope_by_snapid(repo, 2, 4).collect()] == [(1, "h", 5432, "17", 2, 4)]
    assert catalogue.reportable(catalogue.report_scope_by_snapid(repo, 2, 2)).count() == 0
    day = catalogue.report_scope_by_time(repo, "2024-02-02 00:00:00", "2024-02-02 23:59:59").first()
    assert (day["begin"], day["end"]) == (3, 4)
    sections = dict(catalogue.run_reports(repo, "dat", catalogue.report_scope_by_snapid(repo)))
    assert float(sections[1]["dbstats"].first()["xact_commit_tps"]) > 0


def test_catalogue_ids():
    assert catalogue.find_report(None) == "All"
    assert catalogue.find_report("su") == "Summary"
    assert catalogue.find_report("D") == "DatabaseStatistics"
    assert catalogue.find_report("di") == "DiskUsage"
    assert catalogue.find_report("ALL") == "All"
    with pytest.raises(ValueError):
        catalogue.find_report("x")
    assert set(catalogue.LOOKUP) == set(catalogue.SECTIONS) | {"All"}


def test_every_section_runs(spark, repo):
    for name, frame in catalogue.report(repo, "All", 1, 4).items():
        assert frame.columns, name
    assert catalogue.report(repo, "Inst", 1, 4)["wal_stats"].count() == 1


def test_abandoned_ids_are_not_reused(spark, tmp_path):
    root = str(tmp_path / "r")
    assert [sink.claim_snapshot(spark, root) for _ in range(3)] == [1, 2, 3]


def test_retention(spark, root, tmp_path):
    import shutil

    copy = str(tmp_path / "copy")
    shutil.copytree(root, copy)
    retention.del_snapshot(spark, copy, 4)
    repo = Repository(spark, path=copy)
    assert [r[0] for r in repo.table("snapshot").select("snapid").orderBy("snapid").collect()] == [1, 2, 3, 5]
    assert repo.table("database").where("snapid = 4").count() == 0
    retention.del_snapshots_before(spark, copy, DAY + timedelta(hours=1))
    repo = Repository(spark, path=copy)
    for name in ("snapshot", "database", "table"):
        assert sorted(r[0] for r in repo.table(name).select("snapid").collect()) == [2, 3, 5]
    retention.del_repolog(spark, copy, DAY + timedelta(hours=25))
    assert Repository(spark, path=copy).table("log").count() == 1
    dropped = retention.expire_days(spark, copy, "table", (DAY + timedelta(days=2)).date())
    assert [d.day for d in dropped] == [1, 2]


def test_register_keeps_ids_and_updates_versions(spark):
    cols = "name string, hostname string, port int, pg_version string"
    first = register.register_instances(
        spark.createDataFrame([], schemas.struct("instance")),
        sink.conform(spark.createDataFrame([("a", "h", 1, "16"), ("b", "h", 2, "16")], cols), "instance"),
    )
    again = register.register_instances(
        first, sink.conform(spark.createDataFrame([("b", "h", 2, "17"), ("c", "h", 3, "17")], cols), "instance")
    )
    got = {r["name"]: (r["instid"], r["pg_version"]) for r in again.collect()}
    assert got == {"a": (1, "16"), "b": (2, "17"), "c": (3, "17")}


def test_hardware_changes_only(spark):
    stored = spark.sql("SELECT 1L instid, TIMESTAMP'2024-01-01' timestamp, 8L mem_total UNION ALL SELECT 1L, TIMESTAMP'2024-01-02', 16L")
    offer = lambda n, v: spark.sql(f"SELECT {n}L instid, TIMESTAMP'2024-01-03' timestamp, {v}L mem_total")
    assert register.changed_hardware(stored, offer(1, 16), "meminfo").count() == 0
    assert register.changed_hardware(stored, offer(1, 8), "meminfo").count() == 1
    assert register.changed_hardware(stored, offer(2, 8), "meminfo").count() == 1


def test_bulk_load(spark, tmp_path):
    file = tmp_path / "schema.tsv"
    file.write_text("4\t1\t2200\tpublic\n4\t1\t11\tnull\n")
    got = logfile.bulk_load(spark, str(file), "schema").orderBy("nsp").collect()
    assert [tuple(r) for r in got] == [(4, 1, 11, None), (4, 1, 2200, "public")]
    file = tmp_path / "index.tsv"
    names = schemas.column_names("index")
    row = dict.fromkeys(names, "null") | {"snapid": "1", "idx": "5", "indkey": "1 3", "reloptions": "{a=b,fillfactor=70}"}
    file.write_text("\t".join(row[n] for n in names) + "\n")
    got = logfile.bulk_load(spark, str(file), "index").first()
    assert (got["indkey"], got["reloptions"]) == ([1, 3], ["a=b", "fillfactor=70"])


def test_wal_file_names(spark):
    got = spark.range(1).select(
        collect.wal_file(F.lit("0/3000000"), F.lit(1)).alias("a"), collect.wal_file(F.lit("0/3000001"), F.lit(1)).alias("b")
    ).first()
    assert (got["a"], got["b"]) == ("000000010000000000000002", "000000010000000000000003")


def test_ht_info_without_statements(spark):
    one = lambda n: spark.sql(f"SELECT {n}L AS dealloc, TIMESTAMP'2024-01-01' AS stats_reset")
    got = collect.ingest_ht_info(one(1), one(2)).first()
    assert (got["statements_dealloc"], got["wait_sampling_dealloc"], got["rusage_dealloc"]) == (None, 1, 2)
