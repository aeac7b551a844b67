"""Streaming twins of the sample roll-ups.

All work in append mode under one watermark: a snapshot window comes out once, when no sample of it can still arrive.
Counters that are compared with the sample before are held in state until the watermark passes them and are then taken
in order of time, so samples may come late and shuffled by as much as the watermark allows.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.streaming import samples

LATENESS = "2 minutes"
WINDOW_SECONDS = 600
HOLD = T.StructType([T.StructField("held", T.StringType())])


def _window(width: str) -> Column:
    return F.window("sampled_at", width).alias("w")


def activity_stream(backends: DataFrame, width: str = samples.SNAPSHOT_WINDOW, lateness: str = LATENESS) -> DataFrame:
    """Twin of ``samples.activity_rollup``: counts per sample, then sums and the largest sample per window.

    Two aggregations in a row share the watermark; state is a row per open sample and one per open window of a server.
    """
    clients = samples.clients(backends.withWatermark("sampled_at", lateness))
    per_sample = clients.groupBy("instid", "sampled_at").agg(*samples.sample_counts())
    rolled = per_sample.groupBy(_window(width), "instid").agg(*samples.window_counts())
    return rolled.select(F.col("w.start").alias("snap_start"), *[c for c in rolled.columns if c != "w"])


def rusage_stream(
    executions: DataFrame, width: str = samples.SNAPSHOT_WINDOW, lateness: str = LATENESS, by_level: bool = True
) -> DataFrame:
    """Twin of ``samples.rusage_rollup``; state is a row per open window and query."""
    keys = [*samples.RUSAGE_KEY, *(["toplevel"] if by_level else [])]
    timed = executions.withWatermark("sampled_at", lateness)
    rolled = timed.groupBy(_window(width), *keys).agg(*samples.usage_totals())
    return rolled.select(F.col("w.start").alias("snap_start"), *[c for c in rolled.columns if c != "w"])


def _micros(values: pd.Series) -> list[int]:
    return [int(v.value // 1000) for v in values]


def _load(state: GroupState) -> dict:
    return json.loads(state.get[0]) if state.exists else {"last": None, "waiting": [], "open": {}}


def _save(state: GroupState, held: dict, wake: int | None) -> None:
    """Keep what is held until ``wake`` (microseconds); the last sample alone needs no timer."""
    state.update((json.dumps(held),))
    if wake is not None:
        state.setTimeoutTimestamp(max(wake // 1000 + 1, state.getCurrentWatermarkMs() + 1))


def _released(held: dict, watermark: int) -> list[list]:
    """Waiting samples that nothing earlier can precede any more, in order of time."""
    held["waiting"].sort(key=lambda r: r[0])
    ready = [r for r in held["waiting"] if r[0] <= watermark]
    held["waiting"] = held["waiting"][len(ready) :]
    return ready


def _numbers(rows: pd.DataFrame, columns: Sequence[str]) -> list[list]:
    """Rows as plain values: the time in microseconds, then whole numbers or nulls."""
    values = [[None if v is None or v != v else int(v) for v in rows[c]] for c in columns]
    return [list(r) for r in zip(_micros(rows["sampled_at"]), *values, strict=True)]


def disk_stream(disks: DataFrame, width_seconds: int = WINDOW_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """Twin of ``samples.disk_rollup``: peak sectors per second and counter wraps per device and window.

    State of a device: its last sample, the samples the watermark has not passed, and peaks and wraps of at most the
    windows these touch.
    """
    counters = list(samples._DISK)
    flags = [f"overflow_{short}" for short in samples._DISK.values()]
    out = T.StructType.fromDDL(
        "snap_start timestamp, instid bigint, device string, device_rsps_max double, device_wsps_max double, "
        + ", ".join(f"{f} bigint" for f in flags)
    )
    width = width_seconds * 1_000_000

    def fold(held: dict, sample: list) -> None:
        at, values = sample[0], sample[1:]
        row = held["open"].setdefault(str(at // width * width), [0.0, 0.0, *[0] * len(counters)])
        if held["last"] is not None:
            seconds = at // 1_000_000 - held["last"][0] // 1_000_000
            moved = [None if a is None or b is None else a - b for a, b in zip(values, held["last"][1:], strict=True)]
            for place, counter in enumerate(("rd_sectors", "wr_sectors")):
                step = moved[counters.index(counter)]
                if seconds > 0 and step is not None and step >= 0:
                    row[place] = max(row[place], step / seconds)
            for place, step in enumerate(moved, 2):
                row[place] += step is not None and step < 0
        held["last"] = sample

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, watermark = _load(state), state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for rows in batches:
                held["waiting"] += _numbers(rows, counters)
        for sample in _released(held, watermark):
            fold(held, sample)
        # a window is whole once its end has passed and nothing that waits falls into it
        closed = sorted(int(w) for w in held["open"] if int(w) + width <= watermark)
        done = [(pd.Timestamp(w, unit="us"), *key, *held["open"].pop(str(w))) for w in closed]
        ends = [int(w) + width for w in held["open"]] + [r[0] for r in held["waiting"]]
        _save(state, held, min(ends) if ends else None)
        if done:
            yield pd.DataFrame(done, columns=out.names)

    timed = disks.withWatermark("sampled_at", lateness).select("instid", "device", "sampled_at", *counters)
    return timed.groupBy("instid", "device").applyInPandasWithState(run, out, HOLD, "append", GroupStateTimeout.EventTimeTimeout)


def cpu_overflow_stream(marks: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Twin of ``samples.cpu_overflow`` on marks ``(instid, snapid, sampled_at, counters)``: flags of counters that went down.

    State of a server: its last mark and those the watermark has not passed.
    """
    counters = list(samples.CPU_COUNTERS)
    flags = [c.replace("cpu_", "overflow_") for c in counters]
    out = T.StructType.fromDDL(
        "instid bigint, snapid bigint, sampled_at timestamp, " + ", ".join(f"{c} bigint" for c in counters) + ", " + ", ".join(f"{f} smallint" for f in flags)
    )

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, watermark, done = _load(state), state.getCurrentWatermarkMs() * 1000, []
        if not state.hasTimedOut:
            for rows in batches:
                held["waiting"] += _numbers(rows, ["snapid", *counters])
        for mark in _released(held, watermark):
            last = held["last"] or [None] * len(mark)
            down = [int(a is not None and b is not None and a < b) for a, b in zip(mark[2:], last[2:], strict=True)]
            done.append((key[0], mark[1], pd.Timestamp(mark[0], unit="us"), *mark[2:], *down))
            held["last"] = mark
        _save(state, held, held["waiting"][0][0] if held["waiting"] else None)
        if done:
            yield pd.DataFrame(done, columns=out.names)

    timed = marks.withWatermark("sampled_at", lateness).select("instid", "snapid", "sampled_at", *counters)
    return timed.groupBy("instid").applyInPandasWithState(run, out, HOLD, "append", GroupStateTimeout.EventTimeTimeout)


def long_xact_stream(
    backends: DataFrame,
    width_seconds: int = WINDOW_SECONDS,
    keep: int = samples.LONG_TRANSACTIONS_KEPT,
    lateness: str = LATENESS,
) -> DataFrame:
    """Twin of ``samples.long_xact_rollup``: the ``keep`` longest transactions of each window, as last seen in it.

    State of a server: the samples the watermark has not passed and, per open window, the transactions of its latest
    sample and the ``keep`` longest of those that were gone by then.  One that comes back leaves the ended ones; its
    time has only grown, so whatever it pushed out stays out.
    """
    out = T.StructType.fromDDL("snap_start timestamp, instid bigint, client string, pid bigint, start timestamp, duration double, query string")
    width = width_seconds * 1_000_000

    def rank(entry: list) -> tuple:
        name, at, _ = entry
        client, pid, start = name
        return start - at, (pid is not None, pid or 0), start, (client is not None, client or "")

    def fold(held: dict, at: int, seen: list[list]) -> None:
        window = held["open"].setdefault(str(at // width * width), {"running": [], "ended": []})
        now = {tuple(name): [name, at, query] for _, name, query in sorted(seen, key=lambda r: (r[2] is not None, r[2] or ""))}
        gone = [e for e in window["running"] + window["ended"] if tuple(e[0]) not in now]
        window["running"], window["ended"] = list(now.values()), sorted(gone, key=rank)[:keep]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, watermark = _load(state), state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for rows in batches:
                times, starts = _micros(rows["sampled_at"]), _micros(rows["xact_start"])
                for at, start, client, pid, query in zip(times, starts, rows["client"], rows["pid"], rows["query"], strict=True):
                    pid = None if pid is None or pid != pid else int(pid)
                    held["waiting"].append([at, [client, pid, start], query])
        ready = _released(held, watermark)
        for at, seen in itertools.groupby(ready, key=lambda r: r[0]):
            fold(held, at, list(seen))
        done = []
        for w in sorted(int(w) for w in held["open"] if int(w) + width <= watermark):
            window = held["open"].pop(str(w))
            for (client, pid, start), at, query in sorted(window["running"] + window["ended"], key=rank)[:keep]:
                done.append((pd.Timestamp(w, unit="us"), key[0], client, pid, pd.Timestamp(start, unit="us"), (at - start) / 1e6, query))
        ends = [int(w) + width for w in held["open"]] + [r[0] for r in held["waiting"]]
        if ends:
            _save(state, held, min(ends))
        elif state.exists:
            state.remove()
        if done:
            frame = pd.DataFrame(done, columns=out.names)
            frame["pid"] = frame["pid"].astype("Int64")
            yield frame

    timed = samples.long_running(backends.withWatermark("sampled_at", lateness))
    timed = timed.select("instid", "client", F.col("pid").cast("bigint").alias("pid"), "xact_start", "sampled_at", samples.shown_query().alias("query"))
    return timed.groupBy("instid").applyInPandasWithState(run, out, HOLD, "append", GroupStateTimeout.EventTimeTimeout)


def wait_stream(
    waits: DataFrame,
    width_seconds: int = WINDOW_SECONDS,
    lateness: str = LATENESS,
    keep_queries: bool = True,
    every_window: bool = False,
) -> DataFrame:
    """Twin of ``samples.wait_profile``: running totals per key, once for each window that adds to them.

    Samples are counted per window and batch of rows before they are shuffled, so a busy key sends few rows.
    ``every_window`` also repeats the total of a key at the end of each later window without a sample of it.  State: one
    entry per key ever seen (its total, its last window and the counts of windows still open), some 200 bytes.
    """
    key = T.StructType.fromDDL("instid bigint, dbid bigint, userid bigint, queryid bigint, backend_type string, event_type string, event string")
    counted = T.StructType([*key.fields, *T.StructType.fromDDL("snap_start bigint, sampled_at timestamp, n bigint").fields])
    out = T.StructType([T.StructField("snap_start", T.TimestampType()), *key.fields, T.StructField("count", T.LongType())])
    width = width_seconds * 1_000_000

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pc.cast(batch["sampled_at"], pa.int64())
            start = pc.multiply(pc.divide(at, width), width)
            table = pa.Table.from_batches([batch]).append_column("snap_start", start)
            table = table.group_by([*key.names, "snap_start"]).aggregate([("sampled_at", "max"), ([], "count_all")])
            table = table.rename_columns({"sampled_at_max": "sampled_at", "count_all": "n"}).select(counted.names)
            yield from table.to_batches()

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"n": 0, "last": None, "open": {}}
        watermark = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for rows in batches:
                for start, n in zip(rows["snap_start"], rows["n"], strict=True):
                    # a window that has come out takes no more samples
                    if held["last"] is None or start > held["last"]:
                        held["open"][str(start)] = held["open"].get(str(start), 0) + int(n)
        done: list[tuple[int, int]] = []

        def fill(until: int) -> None:
            while every_window and held["last"] is not None and held["last"] + width < until:
                held["last"] += width
                done.append((held["last"], held["n"]))

        for start in sorted(int(w) for w in held["open"] if int(w) + width <= watermark):
            fill(start)
            held["n"], held["last"] = held["n"] + held["open"].pop(str(start)), start
            done.append((start, held["n"]))
        fill(watermark // width * width)
        ends = [int(w) + width for w in held["open"]]
        if every_window and held["last"] is not None:
            ends.append(held["last"] + 2 * width)
        _save(state, held, min(ends) if ends else None)
        if done:
            frame = pd.DataFrame({"snap_start": [pd.Timestamp(w, unit="us") for w, _ in done]})
            for field, value in zip(key.fields, name, strict=True):
                kind = object if isinstance(field.dataType, T.StringType) else "Int64"
                frame[field.name] = pd.Series([None if value != value else value] * len(done), dtype=kind)
            frame["count"] = [n for _, n in done]
            yield frame

    waiting = waits.where(F.col("event").isNotNull() & F.col("sampled_at").isNotNull())
    if not keep_queries:
        waiting = waiting.withColumn("queryid", F.lit(0))
    waiting = waiting.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in key.fields], "sampled_at")
    timed = waiting.mapInArrow(count, counted).withWatermark("sampled_at", lateness)
    return timed.groupBy(*key.names).applyInPandasWithState(run, out, HOLD, "append", GroupStateTimeout.EventTimeTimeout)
