"""Event tables against time: interval join, as-of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR = 3600


def bucket(t: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(t) / F.lit(seconds))


def interval_join(
    events: DataFrame,
    intervals: DataFrame,
    at: str,
    start: str,
    end: str,
    on: list[str],
    seconds: int = HOUR,
) -> DataFrame:
    """Events inside ``[start, end]`` of an interval with the same ``on`` keys.

    Intervals are copied to every bucket of ``seconds`` they touch, events have
    one bucket, so the range condition runs inside an equi-join: hash-broadcast
    when the intervals are small, otherwise a shuffle whose hot buckets the
    adaptive skew join can split.
    """
    spread = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn(
        "_bucket",
        F.explode(F.sequence(bucket(F.col(start), seconds), bucket(F.col(end), seconds))),
    )
    marked = events.withColumn("_bucket", bucket(F.col(at), seconds))
    joined = marked.join(spread, [*on, "_bucket"])
    return joined.where(F.col(at).between(F.col(start), F.col(end))).drop("_bucket")


def as_of(df: DataFrame, at: str, start: Column, end: Column, floor: str) -> DataFrame:
    """Change rows in force during ``[start, end]``: those inside plus the one before.

    ``df`` holds one instance; the row before is found by an aggregate, so only
    the change rows themselves are read twice.
    """
    before = df.where(F.col(at) <= start).agg(F.max(at)).scalar()
    return df.where(F.col(at).between(F.coalesce(before, F.lit(floor).cast("timestamp")), end))
