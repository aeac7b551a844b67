"""Operating-system resources: processor, load, memory, disks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clock import minute_label, span
from tidemark.functions.numeric import div, mean, mib, quotient, round_real, tps, unwrap
from tidemark.functions.text import merged_arrays
from tidemark.operators.delta import with_previous
from tidemark.plans.common import in_scope, label, scope_length
from tidemark.repository import Repository

CPU_STATES = ("user", "system", "idle", "iowait")


def _cpu_shares(repo: Repository, begin: int, end: int) -> DataFrame:
    steps = with_previous(
        in_scope(repo, "cpu", begin, end),
        ["instid"],
        [f"cpu_{s}" for s in CPU_STATES],
        scope_length=scope_length(begin, end),
    ).where(F.col("snapid") > begin)

    def spent(state: str) -> Column:
        wrapped = (F.col(f"overflow_{state}") == 1).cast("int")
        return unwrap(F.col(f"cpu_{state}"), F.coalesce(wrapped, F.lit(0))) - F.col(f"prev_cpu_{state}")

    total = spent("user") + spent("system") + spent("idle") + spent("iowait")
    return steps.select(
        "snapid", "time", *[(div(spent(s), total) * 100).cast("decimal(10,1)").alias(s) for s in CPU_STATES]
    )


def cpu_usage_tendency(repo: Repository, begin: int, end: int) -> DataFrame:
    return _cpu_shares(repo, begin, end).orderBy("snapid").select("snapid", *CPU_STATES)


def cpu_usage_tendency_report(repo: Repository, begin: int, end: int) -> DataFrame:
    return label(_cpu_shares(repo, begin, end)).orderBy("snapid").select("timestamp", *CPU_STATES)


_LOADS = ("loadavg1", "loadavg5", "loadavg15")


def cpu_loadavg_tendency(repo: Repository, begin: int, end: int) -> DataFrame:
    loads = repo.ranged("loadavg", begin, end)
    return (
        label(_cpu_shares(repo, begin, end).join(loads, "snapid"))
        .orderBy("snapid")
        .select("timestamp", *CPU_STATES, *[round_real(F.col(c), "decimal(10,3)").alias(c) for c in _LOADS])
    )


def cpu_loadavg_with_average(repo: Repository, begin: int, end: int) -> DataFrame:
    rows = cpu_loadavg_tendency(repo, begin, end)
    average = rows.agg(
        *[mean(F.col(s), "decimal(10,1)").alias(s) for s in CPU_STATES],
        *[mean(F.col(c), "decimal(10,3)").alias(c) for c in _LOADS],
    ).withColumn("timestamp", F.lit("Average"))
    return rows.unionByName(average)


def loadavg_tendency(repo: Repository, begin: int, end: int) -> DataFrame:
    return (
        label(in_scope(repo, "loadavg", begin, end))
        .orderBy("snapid")
        .select(
            "timestamp",
            *[round_real(F.col(f"loadavg{m}"), "decimal(10,3)").alias(f"{m}min") for m in (1, 5, 15)],
        )
    )


def memory_tendency(repo: Repository, begin: int, end: int) -> DataFrame:
    gauges = ("memfree", "buffers", "cached", "swap", "dirty")
    return (
        label(in_scope(repo, "memory", begin, end))
        .orderBy("snapid")
        .select("timestamp", *[quotient(F.col(g), F.lit(1024)).cast("decimal(30,2)").alias(g) for g in gauges])
    )


# raw counter -> its wrap count
_DEVICE = {
    "device_readsector": "overflow_drs",
    "device_writesector": "overflow_dws",
    "device_readtime": "overflow_drt",
    "device_writetime": "overflow_dwt",
    "device_iototaltime": "overflow_dit",
}


def _moved(counter: str) -> Column:
    return unwrap(F.col(counter), F.col(_DEVICE[counter])) - F.col(f"prev_{counter}")


def io_usage(repo: Repository, begin: int, end: int) -> DataFrame:
    steps = with_previous(
        in_scope(repo, "device", begin, end).where(F.col("device_name").isNotNull()),
        ["device_name"],
        list(_DEVICE),
        scope_length=None,  # one name may cover several devices in a snapshot
    ).where(F.col("snapid") > begin)

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    def sectors_mib(counter: str) -> Column:
        return F.round(total(_moved(counter)).cast("decimal(24,6)") / F.lit(2048)).cast("bigint")

    return (
        steps.groupBy("device_name")
        .agg(
            merged_arrays(F.col("device_tblspaces")).alias("device_tblspaces"),
            sectors_mib("device_readsector").alias("total_read"),
            sectors_mib("device_writesector").alias("total_write"),
            total(_moved("device_readtime")).alias("total_read_time"),
            total(_moved("device_writetime")).alias("total_write_time"),
            mean(F.col("device_ioqueue")).alias("io_queue"),
            total(_moved("device_iototaltime")).alias("total_io_time"),
            round_real(F.max("device_rsps_max") / 2, "decimal(30,2)").alias("read_size_tps_peak"),
            round_real(F.max("device_wsps_max") / 2, "decimal(30,2)").alias("write_size_tps_peak"),
        )
        .orderBy("device_name")
    )


def io_usage_tendency(repo: Repository, begin: int, end: int) -> DataFrame:
    kept = [c for c in _DEVICE if c != "device_iototaltime"]
    marks = (
        in_scope(repo, "device", begin, end)
        .where(F.col("device_name").isNotNull())
        .groupBy("snapid", "time", "device_name")
        .agg(
            *[F.sum(c).alias(c) for c in kept],
            *[F.sum(_DEVICE[c]).alias(_DEVICE[c]) for c in kept],
            F.sum("device_rsps_max").alias("rsps"),
            F.sum("device_wsps_max").alias("wsps"),
        )
    )
    steps = with_previous(
        marks, ["device_name"], ["time", *kept], scope_length=scope_length(begin, end)
    ).where(F.col("snapid") > begin)
    lasted = span(F.col("time"), F.col("prev_time"))

    def rate(counter: str, divisor: int, kind: str) -> Column:
        per_second = tps(_moved(counter), lasted).cast("decimal(24,6)") / F.lit(divisor)
        return F.coalesce(per_second, F.lit(0)).cast(kind)

    return steps.orderBy("snapid", "device_name").select(
        minute_label(F.col("time")).alias("timestamp"),
        "device_name",
        rate("device_readsector", 2, "decimal(30,2)").alias("read_size_tps"),
        rate("device_writesector", 2, "decimal(30,2)").alias("write_size_tps"),
        rate("device_readtime", 10, "decimal(30,1)").alias("read_time_rate"),
        rate("device_writetime", 10, "decimal(30,1)").alias("write_time_rate"),
        round_real(F.col("rsps") / 2, "decimal(30,2)").alias("read_size_tps_peak"),
        round_real(F.col("wsps") / 2, "decimal(30,2)").alias("write_size_tps_peak"),
    )


def disk_usage_tablespace(repo: Repository, begin: int, end: int) -> DataFrame:
    return (
        repo.at("tablespace", end)
        .orderBy("name")
        .select(
            F.col("name").alias("spcname"),
            "location",
            "device",
            mib(F.col("total") - F.col("avail")).alias("used"),
            mib(F.col("avail")).alias("avail"),
            div(F.col("avail") * 100, F.col("total")).cast("decimal(30,1)").alias("remain"),
        )
    )
