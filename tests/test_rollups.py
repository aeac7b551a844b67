"""Streaming roll-ups equal their batch twins: late and shuffled input, many batches, a restart in the middle."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import rollups, samples

T0 = datetime(2024, 6, 1, 12, 0)
FAR = T0 + timedelta(days=2)


def spread(rng, rows, at, files=6, late=60):
    """Files of rows that come up to ``late`` seconds out of order."""
    rows = sorted(rows, key=lambda r: r[at] + timedelta(seconds=rng.uniform(0, late)))
    size = -(-len(rows) // files)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def streamed(spark, tmp_path, ddl, files, build):
    """Rows of a streaming frame over the files: half of them, then a new query from the checkpoint for the rest."""
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for half in (files[: len(files) // 2], files[len(files) // 2 :]):
        for rows in half:
            spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(source)
        query = build(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)


def same(stream, batch, until):
    """All rows of windows (or marks) before the closing record, each once."""
    column = "snap_start" if "snap_start" in batch.columns else "sampled_at"
    want = batch.where(F.col(column) < F.lit(until)).select(*stream.columns)
    a, b = (sorted(map(tuple, df.collect()), key=str) for df in (stream.where(F.col(column) < F.lit(until)), want))
    assert a == b and len(a) > 5


DISKS = "instid long, device string, sampled_at timestamp, rd_sectors long, rd_ticks long, wr_sectors long, wr_ticks long, rq_ticks long"


def test_disk_stream(spark, tmp_path):
    rng, rows = random.Random(1), []
    for instid in (1, 2):
        for device in ("a", "b"):
            values = [0] * 5
            for i in range(120):
                values = [rng.choice([v + rng.randrange(5000), 3]) if rng.random() < 0.05 else v + rng.randrange(900) for v in values]
                kept = [None if rng.random() < 0.02 else v for v in values]
                rows.append((instid, device, T0 + timedelta(seconds=30 * i + rng.choice([0, 0.25])), *kept))
    files = spread(rng, rows, 2) + [[(i, d, FAR, 0, 0, 0, 0, 0) for i in (1, 2) for d in ("a", "b")], [(9, "z", FAR + timedelta(days=1), 0, 0, 0, 0, 0)]]
    got = streamed(spark, tmp_path, DISKS, files, rollups.disk_stream)
    same(got, samples.disk_rollup(spark.createDataFrame([r for f in files for r in f], DISKS)), FAR)


CPUS = "instid long, snapid long, sampled_at timestamp, cpu_user long, cpu_system long, cpu_idle long, cpu_iowait long"


def test_cpu_overflow_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, 10 * n + i, T0 + timedelta(seconds=20 * n), *[rng.randrange(10 + n) for _ in range(4)]) for i in (1, 2) for n in range(60)]
    files = spread(rng, rows, 2) + [[(9, 9999, FAR, 0, 0, 0, 0)]]
    got = streamed(spark, tmp_path, CPUS, files, rollups.cpu_overflow_stream)
    same(got, samples.cpu_overflow(spark.createDataFrame(rows, CPUS)), FAR)


BACKENDS = "instid long, sampled_at timestamp, backend_type string, is_sampler boolean, wait_event_type string, state string"


def test_activity_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = [
        (i, T0 + timedelta(seconds=30 * n), rng.choice(["client backend", "walwriter"]), rng.random() < 0.1, rng.choice([None, "Lock", "IO"]), rng.choice(["idle", "active", "idle in transaction", None]))
        for i in (1, 2) for n in range(120) for _ in range(rng.randrange(1, 6))
    ]
    files = spread(rng, rows, 1) + [[(9, FAR, "client backend", False, None, "idle")]]
    got = streamed(spark, tmp_path, BACKENDS, files, rollups.activity_stream)
    same(got, samples.activity_rollup(spark.createDataFrame(rows, BACKENDS)), FAR)


USAGE = "instid long, dbid long, userid long, queryid long, toplevel boolean, kind string, sampled_at timestamp, " + ", ".join(f"{c} long" for c in samples._USAGE)


@pytest.mark.parametrize("by_level", [True, False])
def test_rusage_stream(spark, tmp_path, by_level):
    rng = random.Random(4)
    rows = [
        (1, 1, 1, rng.randrange(4), rng.random() < 0.5, rng.choice(["plan", "exec"]), T0 + timedelta(seconds=rng.randrange(3600)), *[rng.randrange(99) for _ in samples._USAGE])
        for _ in range(500)
    ]
    files = spread(rng, rows, 6) + [[(9, 1, 1, 1, True, "plan", FAR, *[0] * len(samples._USAGE))]]
    got = streamed(spark, tmp_path, USAGE, files, lambda df: rollups.rusage_stream(df, by_level=by_level))
    same(got, samples.rusage_rollup(spark.createDataFrame(rows, USAGE), by_level=by_level), FAR)


SESSIONS = "instid long, client string, pid long, xact_start timestamp, sampled_at timestamp, backend_type string, state string, query string, in_vacuum boolean"


def test_long_xact_stream(spark, tmp_path):
    rng, rows = random.Random(5), []
    for i in (1, 2):
        for pid in range(30):
            at = T0 + timedelta(seconds=rng.randrange(300))
            while at < T0 + timedelta(hours=1):
                end = at + timedelta(seconds=rng.choice([0.5, 20, 400, 900]))
                for n in range(120):
                    seen = T0 + timedelta(seconds=30 * n)
                    if at <= seen < end:
                        rows.append((i, rng.choice([None, "h"]) if pid < 3 else f"c{pid}", pid, at, seen, rng.choice(["client backend"] * 9 + ["walwriter"]),
                                     rng.choice(["active", "idle in transaction"]), f"q{seen}", rng.random() < 0.1))
                at = end + timedelta(seconds=rng.randrange(1, 200))
    files = spread(rng, rows, 4) + [[(9, "x", 1, T0, FAR, "client backend", "active", "q", False)], [(9, "x", 1, T0, FAR + timedelta(days=1), "client backend", "active", "q", False)]]
    got = streamed(spark, tmp_path, SESSIONS, files, lambda df: rollups.long_xact_stream(df, keep=4))
    same(got, samples.long_xact_rollup(spark.createDataFrame(rows, SESSIONS), keep=4), FAR)


WAITS = "instid long, dbid long, userid long, queryid long, backend_type string, event_type string, event string, sampled_at timestamp"


def _waits(rng):
    rows = [
        (rng.choice([1, 2]), 1, rng.choice([None, 7]), rng.choice([None, 1, 2**60 + 1]), rng.choice(["client backend", None]), "Lock", rng.choice(["a", "b", None]), T0 + timedelta(seconds=rng.randrange(7200)))
        for _ in range(900)
    ]
    rows += [(3, 1, 1, 1, "x", "IO", "rare", T0 + timedelta(minutes=m)) for m in (1, 61)]
    return rows, spread(rng, rows, 7) + [[(9, 1, 1, 1, "x", "IO", "end", FAR)]]


@pytest.mark.parametrize("keep", [True, False])
def test_wait_stream(spark, tmp_path, keep):
    rows, files = _waits(random.Random(6))
    got = streamed(spark, tmp_path, WAITS, files, lambda df: rollups.wait_stream(df, keep_queries=keep))
    same(got, samples.wait_profile(spark.createDataFrame(rows, WAITS), keep_queries=keep), FAR)


def test_wait_stream_repeats_totals(spark, tmp_path):
    rows, files = _waits(random.Random(7))
    last = T0 + timedelta(hours=3)
    files[-1] = [(9, 1, 1, 1, "x", "IO", "end", last + timedelta(minutes=2))]
    got = streamed(spark, tmp_path, WAITS, files, lambda df: rollups.wait_stream(df, every_window=True)).collect()
    want = {}
    for r in rows:
        if r[6] is not None:
            n = int((r[7] - T0).total_seconds() // 600)
            for w in range(n, 18):
                want[(T0 + timedelta(minutes=10 * w), *r[:7])] = want.get((T0 + timedelta(minutes=10 * w), *r[:7]), 0) + 1
    assert len(got) == len(want) and {tuple(r)[:8]: r["count"] for r in got} == want
