"""Instances, default thresholds and change-only hardware rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas

IDENTITY = ["name", "hostname", "port"]


def register_instances(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The instance table after an upsert by ``(name, hostname, port)``.

    A known instance keeps its id and takes the new version; a new one gets the
    next id in identity order.
    """
    offered = incoming.dropDuplicates(IDENTITY)
    versions = offered.select(*IDENTITY, F.col("pg_version").alias("_version"))
    kept = stored.join(versions, IDENTITY, "left").withColumn("pg_version", F.coalesce("_version", "pg_version"))
    fresh = offered.join(stored.select(*IDENTITY), IDENTITY, "left_anti")
    top = F.coalesce(stored.agg(F.max("instid")).scalar(), F.lit(0))
    # new servers of one registration run: a handful of rows
    numbered = fresh.withColumn("instid", top + F.row_number().over(Window.orderBy(*IDENTITY)))
    names = schemas.struct("instance").names
    return kept.select(*names).unionByName(numbered.select(*names))


def with_default_thresholds(alert: DataFrame, instance: DataFrame) -> DataFrame:
    """Threshold table with a default row for every instance that has none."""
    missing = instance.select("instid").join(alert.select("instid"), "instid", "left_anti")
    kinds = {f.name: f.dataType for f in schemas.struct("alert").fields}
    defaults = missing.select(
        "instid", *[F.lit(v).cast(kinds[c]).alias(c) for c, v in schemas.DEFAULT_THRESHOLDS.items()]
    )
    return alert.unionByName(defaults)


# columns whose change makes a new row
WATCHED = {
    "cpuinfo": ["vendor_id", "model_name", "processors", "sockets"],
    "meminfo": ["mem_total"],
}


def changed_hardware(stored: DataFrame, incoming: DataFrame, table: str) -> DataFrame:
    """Incoming rows that differ from the instance's latest stored row."""
    watched = WATCHED[table]
    latest = stored.groupBy("instid").agg(
        F.max_by(F.struct(*watched), "timestamp").alias("_last"), F.max("timestamp").alias("_at")
    )
    joined = incoming.join(latest, "instid", "left")
    same = F.col("_at").isNotNull() & F.struct(*watched).eqNullSafe(F.col("_last"))
    return joined.where(~same).select(*incoming.columns)


def device_tablespaces(tablespace: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Tablespace names per device with its numbers split."""
    part = lambda i: F.split_part(F.col("device"), F.lit(":"), F.lit(i))
    return (
        tablespace.where(F.col("device").isNotNull())
        .groupBy(*keys, "device")
        .agg(F.array_sort(F.collect_set("name")).alias("names"))
        .select(*keys, "device", part(1).alias("device_major"), part(2).alias("device_minor"), "names")
    )
