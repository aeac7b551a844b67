"""Hardware in force during a scope (change-only tables, as-of reads)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clock import minute_label
from tidemark.functions.numeric import size_pretty_system
from tidemark.operators.events import as_of
from tidemark.repository import Repository

# Fixed value: lower bound when no change row precedes the scope.
EPOCH = "1997-01-29"


def _in_force(repo: Repository, name: str, begin: int, end: int) -> DataFrame:
    scope = repo.bounds(begin, end)
    mine = repo.table(name).where(F.col("instid") == scope.instid)
    rows = as_of(mine, "timestamp", scope.start, scope.end, EPOCH)
    return rows.orderBy("timestamp").withColumn("timestamp", minute_label(F.col("timestamp")))


def cpuinfo(repo: Repository, begin: int, end: int) -> DataFrame:
    return _in_force(repo, "cpuinfo", begin, end).drop("instid")


def meminfo(repo: Repository, begin: int, end: int) -> DataFrame:
    rows = _in_force(repo, "meminfo", begin, end)
    return rows.select("timestamp", size_pretty_system(F.col("mem_total")).alias("mem_total"))
