"""Replication delays, sender activity and slot counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clock import interval_label, minute_label, to_second
from tidemark.functions.numeric import quotient, size_pretty
from tidemark.functions.text import host, lsn_diff, lsn_part
from tidemark.operators.delta import endpoint_pair, since_reset
from tidemark.operators.ranking import asc, desc
from tidemark.plans.common import in_scope
from tidemark.repository import Repository

SLOT_COUNTERS = [
    "spill_txns", "spill_count", "spill_bytes", "stream_txns", "stream_count", "stream_bytes", "total_txns",
    "total_bytes",
]


def replication_slots_report(repo: Repository, begin: int, end: int) -> DataFrame:
    pair = endpoint_pair(
        repo.at("stat_replication_slots", begin, end), ["slot_name"], begin, end, [*SLOT_COUNTERS, "stats_reset"]
    )
    slot = repo.at("replication_slots", end).select("slot_name", "slot_type", F.col("datoid").alias("dbid"))
    database = repo.at("database", end).select("dbid", F.col("name").alias("slot_datname"))
    e_reset, b_reset = F.col("e_stats_reset"), F.col("b_stats_reset")
    return (
        pair.join(slot, "slot_name", "left")
        .join(database, "dbid", "left")
        .select(
            "slot_name",
            "slot_type",
            "slot_datname",
            *[
                since_reset(F.col(f"e_{c}"), F.col(f"b_{c}"), e_reset, b_reset, null_reset="difference").alias(c)
                for c in SLOT_COUNTERS
            ],
            e_reset.alias("stats_reset"),
        )
        .orderBy(desc("total_bytes"), asc("slot_name"))
    )


def _delay(of: str) -> Column:
    return lsn_diff(lsn_part(F.col("current_location")), lsn_part(F.col(of)))


def replication_delays(repo: Repository, begin: int, end: int) -> DataFrame:
    """Flush and replay lag in bytes of physical (or slot-less) senders."""
    slots = repo.ranged("replication_slots", begin, end).select(
        "snapid", F.col("active_pid").alias("procpid"), "slot_name", "slot_type"
    )
    senders = (
        in_scope(repo, "replication", begin, end)
        .where(F.col("flush_location").isNotNull() & F.col("replay_location").isNotNull())
        .join(slots, ["snapid", "procpid"], "left")
        .where(F.col("slot_name").isNull() | (F.col("slot_type") == "physical"))
    )
    client = F.concat(
        F.coalesce(host(F.col("client_addr")), F.lit("local")),
        F.lit(":"),
        F.coalesce(F.nullif(F.col("application_name"), F.lit("")), F.lit("(none)")),
    )
    return (
        senders.select(
            "snapid",
            minute_label(F.col("time")).alias("timestamp"),
            "client_addr",
            "application_name",
            client.alias("client"),
            _delay("flush_location").alias("flush_delay_size"),
            _delay("replay_location").alias("replay_delay_size"),
            "sync_state",
        )
        .orderBy("snapid", "client")
    )


def replication_activity(repo: Repository, begin: int, end: int) -> DataFrame:
    """Latest row of every sender with mean and peak replay delay; lags in microseconds."""
    delays = (
        replication_delays(repo, begin, end)
        .groupBy("client_addr", "application_name")
        .agg(
            F.max("snapid").alias("snapid"),
            quotient(F.sum("replay_delay_size"), F.count("replay_delay_size"))
            .cast("decimal(30,6)").alias("replay_delay_avg"),
            F.max("replay_delay_size").alias("replay_delay_peak"),
        )
        .alias("d")
    )
    sender = in_scope(repo, "replication", begin, end).alias("r")
    same = (
        (F.col("d.snapid") == F.col("r.snapid"))
        & F.col("d.client_addr").eqNullSafe(F.col("r.client_addr"))
        & (F.col("d.application_name") == F.col("r.application_name"))
    )
    times = repo.timeline(begin, end).select(F.col("snapid"), F.col("time").alias("snap_time"))
    return (
        delays.join(sender, same, "left")
        .select("d.snapid", "replay_delay_avg", "replay_delay_peak", *_SENDER)
        .join(times, "snapid", "left")
        .withColumn("priority_sortkey", F.nullif(F.col("sync_priority"), F.lit(0)))
        .orderBy(desc("snapid"), asc("priority_sortkey"), asc("client_addr"), asc("application_name"))
        .select(
            to_second(F.col("snap_time")).alias("snapshot_time"),
            *[to_second(F.col(c)).alias(c) if c == "backend_start" else F.col(c) for c in _SENDER_SHOWN],
            "replay_delay_avg",
            "replay_delay_peak",
            F.col("write_lag").alias("write_lag_time"),
            F.col("flush_lag").alias("flush_lag_time"),
            F.col("replay_lag").alias("replay_lag_time"),
            "priority_sortkey",
        )
    )


_SENDER_SHOWN = [
    "usename", "application_name", "client_addr", "client_hostname", "client_port", "backend_start", "state",
    "current_location", "sent_location", "write_location", "flush_location", "replay_location", "sync_priority",
    "sync_state",
]
_SENDER = [f"r.{c}" for c in [*_SENDER_SHOWN, "write_lag", "flush_lag", "replay_lag"]]


def replication_status(repo: Repository, begin: int, end: int) -> DataFrame:
    """CLI form: sizes and lags as text."""
    return replication_activity(repo, begin, end).select(
        *_SENDER_SHOWN,
        *[
            size_pretty(F.round(F.col(f"replay_delay_{k}")).cast("bigint")).alias(f"replay_delay_{k}")
            for k in ("avg", "peak")
        ],
        *[interval_label(F.col(f"{k}_lag_time")).alias(f"{k}_lag_time") for k in ("write", "flush", "replay")],
    )
