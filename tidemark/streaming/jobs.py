"""Structured Streaming jobs over the server log.

Progress is the streaming checkpoint.  Its folder must be reachable by all
executors; callers pass it, as they pass the repository root.  Every delivery is named by its stream's
id and batch number, and a batch that Spark delivers again replaces what it stored before.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark import versions
from tidemark.sources.sink import append_events, append_text
from tidemark.streaming import events
from tidemark.streaming.logs import Route, format_log_line, routed

STORE_INTERVAL = "10 seconds"
LATENESS = "10 minutes"
STATE_IDLE_MS = 24 * 3600 * 1000


def store_log(
    log: DataFrame, root: str, checkpoint: str, route: Route, once: bool = False
) -> StreamingQuery:
    """Append accepted records to the day-partitioned ``log`` table."""
    return _start(routed(log, route), checkpoint, lambda df, b: append_events(df, root, "log", b), once)


def route_logs(
    log: DataFrame, checkpoint: str, sinks: Mapping[str, tuple[Route, Callable[[DataFrame, str], None]]], once: bool = False
) -> StreamingQuery:
    """One read of the stream for several destinations with their own thresholds."""

    def deliver(batch: DataFrame, name: str) -> None:
        batch.persist()
        try:
            for route, write in sinks.values():
                write(routed(batch, route), name)
        finally:
            batch.unpersist()

    return _start(log, checkpoint, deliver, once)


def text_sink(path: str, prefix: str, verbosity: int) -> Callable[[DataFrame, str], None]:
    return lambda df, batch: append_text(df.select(format_log_line(prefix, verbosity).alias("value")), path, batch)


def store_vacuum_and_analyze(log: DataFrame, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    def deliver(batch: DataFrame, name: str) -> None:
        batch.persist()
        try:
            append_events(events.autovacuum_events(batch), root, "autovacuum", name)
            append_events(events.autoanalyze_events(batch), root, "autoanalyze", name)
        finally:
            batch.unpersist()

    return _start(log, checkpoint, deliver, once)


def checkpoint_stream(log: DataFrame) -> DataFrame:
    """Streaming twin of ``events.checkpoint_events``."""
    records = events.checkpoint_records(log.withWatermark("timestamp", LATENESS))
    return events._checkpoint_row(_with_previous_record(records, ["instid"], ["kind", "timestamp", "flags"]))


def cancel_stream(log: DataFrame) -> DataFrame:
    """Streaming twin of ``events.cancel_events``."""
    records = events.cancel_records(log.withWatermark("timestamp", LATENESS))
    return events._cancel_row(_with_previous_record(records, ["instid", "worker"], ["kind", "timestamp", "query"]))


def store_checkpoints(log: DataFrame, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    return _start(checkpoint_stream(log), checkpoint, lambda df, b: append_events(df, root, "checkpoint", b), once)


def store_cancels(log: DataFrame, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    def deliver(batch: DataFrame, name: str) -> None:
        batch.persist()
        try:
            append_events(events.autovacuum_cancels(batch), root, "autovacuum_cancel", name)
            append_events(events.autoanalyze_cancels(batch), root, "autoanalyze_cancel", name)
        finally:
            batch.unpersist()

    return _start(cancel_stream(log), checkpoint, deliver, once)


def batch_name(spark: SparkSession, checkpoint: str, batch: int) -> str:
    """Name of a stream's batch: the same whenever it is delivered again.

    The stream's id is kept in its checkpoint, so a checkpoint made anew at the same place names other batches.
    """
    kept = versions.read_text(spark, f"{checkpoint.rstrip('/')}/metadata")
    if kept is None:
        raise RuntimeError(f"{checkpoint} does not belong to a stream")
    return f"q-{json.loads(kept)['id']}-{batch}"


def _start(df: DataFrame, checkpoint: str, deliver: Callable[[DataFrame, str], None], once: bool) -> StreamingQuery:
    writer = df.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda rows, batch: deliver(rows, batch_name(rows.sparkSession, checkpoint, batch)))
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=STORE_INTERVAL)
    return writer.start()


def _with_previous_record(records: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Add ``prev_x`` from the key's previous record, kept as one row of state.

    State of a key that stays silent for a day of event time is dropped.  Only records of interest reach this operator (a few per server and minute);
    they arrive Arrow-batched and are ordered by time inside a micro-batch.
    """
    kept = {c: records.schema[c].dataType for c in cols}
    state_schema = T.StructType([T.StructField(c, t) for c, t in kept.items()])
    out_schema = T.StructType(
        list(records.schema.fields) + [T.StructField(f"prev_{c}", t) for c, t in kept.items()]
    )
    columns, order = list(records.columns), events.ORDER

    def attach(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        before = state.get if state.exists else tuple(None for _ in cols)
        for position, c in enumerate(cols):
            shifted = rows[c].shift(1).astype(object)
            shifted.iloc[0] = before[position]
            rows[f"prev_{c}"] = shifted
        last = rows.iloc[-1]
        state.update(tuple(None if _missing(last[c]) else last[c] for c in cols))
        seen = int(last[order[0]].timestamp() * 1000)
        state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + STATE_IDLE_MS)
        yield rows[columns + [f"prev_{c}" for c in cols]]

    return records.groupBy(*[F.col(k) for k in keys]).applyInPandasWithState(
        attach, out_schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout
    )


def _missing(value: object) -> bool:
    return value is None or value is pd.NaT or (isinstance(value, float) and value != value)
