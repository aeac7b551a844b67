"""Pieces shared by the report plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clock, numeric
from tidemark.repository import Repository


def grew(counter: str) -> Column:
    """Null-tolerant growth of a counter folded by ``endpoint_pair``."""
    return numeric.sub(F.col(f"e_{counter}"), F.col(f"b_{counter}"))


def total_grew(*counters: str) -> Column:
    result = grew(counters[0])
    for counter in counters[1:]:
        result = result + grew(counter)
    return result


def with_pair_times(repo: Repository, df: DataFrame, begin: int, end: int) -> DataFrame:
    """Add ``begin_time`` and ``end_time``; no rows if a snapshot of the pair is missing.

    Both are scalar subqueries on the snapshot dimension, so nothing is joined.
    """
    at = lambda snapid: repo.at("snapshot", snapid).agg(F.max("time")).scalar()
    timed = df.withColumns({"begin_time": at(begin), "end_time": at(end)})
    return timed.where("begin_time IS NOT NULL AND end_time IS NOT NULL")


def in_scope(repo: Repository, name: str, begin: int, end: int) -> DataFrame:
    """Fact rows of the instance's snapshots in ``[begin, end]`` with their time."""
    return repo.ranged(name, begin, end).join(repo.timeline(begin, end), "snapid")


def label(df: DataFrame, name: str = "timestamp") -> DataFrame:
    return df.withColumn(name, clock.minute_label(F.col("time")))


def scope_length(begin: int, end: int) -> int:
    """Most rows one entity can have in the scope."""
    return end - begin + 1
