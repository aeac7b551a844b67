"""Summary and database statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clock import minute_label, seconds_rounded, span, to_second
from tidemark.functions.numeric import mib, np_sub, percent, round_real, size_pretty, tps
from tidemark.operators.delta import endpoint_pair, step, with_previous
from tidemark.operators.ranking import asc, desc
from tidemark.plans.common import grew, in_scope, scope_length, total_grew, with_pair_times
from tidemark.repository import Repository


def _snapids(repo: Repository, since, until) -> DataFrame:
    return (
        repo.table("snapshot")
        .join(repo.table("instance").select("instid", "hostname", "port"), "instid")
        .where(F.col("time").between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")))
    )


def min_snapid(repo: Repository, host: str, port: int | str, since, until) -> DataFrame:
    mine = _snapids(repo, since, until).where((F.col("hostname") == host) & (F.col("port") == int(port)))
    return mine.agg(F.min("snapid").alias("snapid"))


def max_snapid(repo: Repository, host: str, port: int | str, since, until) -> DataFrame:
    mine = _snapids(repo, since, until).where((F.col("hostname") == host) & (F.col("port") == int(port)))
    return mine.agg(F.max("snapid").alias("snapid"))


def min_snapid2(repo: Repository, instid: int | str, since, until) -> DataFrame:
    return _snapids(repo, since, until).where(F.col("instid") == int(instid)).agg(F.min("snapid").alias("snapid"))


def max_snapid2(repo: Repository, instid: int | str, since, until) -> DataFrame:
    return _snapids(repo, since, until).where(F.col("instid") == int(instid)).agg(F.max("snapid").alias("snapid"))


def summary(repo: Repository, begin: int, end: int) -> DataFrame:
    """Instance identity, covered time and totals over databases present at both ends.

    ``duration`` is in whole seconds.
    """
    pair = endpoint_pair(
        repo.at("database", begin, end),
        ["dbid"],
        begin,
        end,
        ["size", "xact_commit", "xact_rollback"],
        presence="both",
    )
    # one struct by one subquery, however many totals there are
    totals = pair.agg(
        F.struct(
            size_pretty(F.sum("e_size")).alias("total_dbsize"),
            (F.sum("e_xact_commit") - F.sum("b_xact_commit")).alias("total_commits"),
            (F.sum("e_xact_rollback") - F.sum("b_xact_rollback")).alias("total_rollbacks"),
        ).alias("t")
    ).scalar()
    who = repo.table("instance").where(F.col("instid") == repo.instance_of(end))
    return (
        with_pair_times(repo, who, begin, end)
        .withColumn("t", totals)
        .select(
            F.col("name").alias("instname"),
            "hostname",
            "port",
            "pg_version",
            to_second(F.col("begin_time")).alias("snap_begin"),
            to_second(F.col("end_time")).alias("snap_end"),
            seconds_rounded(span(F.col("end_time"), F.col("begin_time"))).alias("duration"),
            "t.*",
        )
    )


STATS = [
    "size", "xact_commit", "xact_rollback", "blks_hit", "blks_read", "tup_returned", "tup_fetched",
    "temp_files", "temp_bytes", "deadlocks", "blk_read_time", "blk_write_time",
]


def stats_columns() -> list[Column]:
    """Figures of one database from its counters at both ends and their times."""
    lasted = span(F.col("end_time"), F.col("begin_time"))
    return [
        F.col("e_name").alias("datname"),
        mib(F.col("e_size")).alias("size"),
        mib(grew("size")).alias("size_incr"),
        tps(grew("xact_commit"), lasted).alias("xact_commit_tps"),
        tps(grew("xact_rollback"), lasted).alias("xact_rollback_tps"),
        percent(grew("blks_hit"), total_grew("blks_read", "blks_hit")).alias("blks_hit_rate"),
        tps(total_grew("blks_read", "blks_hit"), lasted).alias("blks_hit_tps"),
        tps(grew("blks_read"), lasted).alias("blks_read_tps"),
        tps(total_grew("tup_returned", "tup_fetched"), lasted).alias("tup_fetch_tps"),
        grew("temp_files").alias("temp_files"),
        mib(grew("temp_bytes")).alias("temp_bytes"),
        grew("deadlocks").alias("deadlocks"),
        round_real(grew("blk_read_time"), "decimal(30,3)").alias("blk_read_time"),
        round_real(grew("blk_write_time"), "decimal(30,3)").alias("blk_write_time"),
    ]


def dbstats(repo: Repository, begin: int, end: int) -> DataFrame:
    pair = endpoint_pair(repo.at("database", begin, end), ["dbid"], begin, end, STATS, at_end=["name"])
    return with_pair_times(repo, pair, begin, end).select(*stats_columns())


def xact_tendency(repo: Repository, begin: int, end: int) -> DataFrame:
    marks = (
        in_scope(repo, "database", begin, end)
        .groupBy("snapid", "time", "name")
        .agg(F.sum("xact_commit").alias("xact_commit"), F.sum("xact_rollback").alias("xact_rollback"))
    )
    steps = with_previous(
        marks, ["name"], ["time", "xact_commit", "xact_rollback"], scope_length=scope_length(begin, end)
    ).where(F.col("snapid") > begin)
    lasted = span(F.col("time"), F.col("prev_time"))

    def rate(counter: str):
        return F.coalesce(tps(F.greatest(step(counter), F.lit(0)), lasted), F.lit(0).cast("decimal(30,3)"))

    return steps.orderBy("snapid", "name").select(
        minute_label(F.col("time")).alias("timestamp"),
        F.col("name").alias("datname"),
        rate("xact_commit").alias("commit_tps"),
        rate("xact_rollback").alias("rollback_tps"),
    )


def dbsize_tendency(repo: Repository, begin: int, end: int) -> DataFrame:
    sizes = (
        in_scope(repo, "database", begin, end).groupBy("snapid", "time", "name").agg(F.sum("size").alias("bytes"))
    )
    return sizes.orderBy("snapid", "name").select(
        minute_label(F.col("time")).alias("timestamp"),
        F.col("name").alias("datname"),
        (F.col("bytes").cast("decimal(24,6)") / F.lit(1048576)).cast("decimal(30,3)").alias("size"),
    )


# report column -> stored counter
_RUSAGE = {
    f"{kind}_{short}": f"{kind}_{stored}"
    for kind in ("plan", "exec")
    for short, stored in {
        "reads": "reads", "writes": "writes", "utime": "user_time", "stime": "system_time"
    }.items()
}


def db_rusage(repo: Repository, begin: int, end: int) -> DataFrame:
    """Resource usage per database, summed over restart-safe steps of each query."""
    steps = with_previous(
        in_scope(repo, "rusage", begin, end),
        ["dbid", "userid", "queryid"],
        list(_RUSAGE.values()),
        scope_length=scope_length(begin, end),
    ).where(F.col("snapid") > begin)
    # reduce to one row per database before names are attached
    used = steps.groupBy("dbid").agg(
        *[F.sum(np_sub(F.col(c), F.col(f"prev_{c}"))).alias(out) for out, c in _RUSAGE.items()]
    )
    names = repo.at("database", end).select("dbid", "name")
    by_name = used.join(names, "dbid").groupBy("name").agg(*[F.sum(out).alias(out) for out in _RUSAGE])
    return by_name.select(
        F.col("name").alias("datname"),
        *[
            round_real(F.col(out), "decimal(30,6)").alias(out) if out.endswith("time") else F.col(out)
            for out in _RUSAGE
        ],
    )


def recovery_conflicts(repo: Repository, begin: int, end: int) -> DataFrame:
    kinds = [f"confl_{k}" for k in ("tablespace", "lock", "snapshot", "bufferpin", "deadlock")]
    pair = endpoint_pair(repo.at("database", begin, end), ["dbid"], begin, end, kinds, at_end=["name"])
    return pair.orderBy(desc(total_grew(*kinds)), asc("e_name")).select(
        F.col("e_name").alias("datname"), *[grew(k).alias(k) for k in kinds]
    )
