"""Report sections by id, report scopes, snapshot list and size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clock import seconds_rounded, to_second
from tidemark.functions.numeric import size_pretty, size_pretty_nearest
from tidemark.functions.text import qualified
from tidemark.operators.ranking import asc
from tidemark.plans import databases, fleet, hardware, instance, maintenance, relations, replication, resources
from tidemark.plans import statements, waits
from tidemark.repository import Repository

Report = Callable[[Repository, int, int], DataFrame]

SNAPID_MIN, SNAPID_MAX = 0, 2**63 - 1


def _limited(report: Callable[..., DataFrame], k: int) -> Report:
    return lambda repo, begin, end: report(repo, begin, end, limit=k)


def _qualified(report: Report) -> Report:
    """Replace the three name columns by one ``db.schema.table`` label."""

    def run(repo: Repository, begin: int, end: int) -> DataFrame:
        rows = report(repo, begin, end)
        label = qualified(F.col("datname"), F.col("nspname"), F.col("relname")).alias("table")
        return rows.select(label, *[c for c in rows.columns if c not in ("datname", "nspname", "relname")])

    return run


# Report ids and their order; sections of a report run independently.
SECTIONS: dict[str, dict[str, Report]] = {
    "Summary": {"summary": databases.summary},
    "Alert": {"alert": maintenance.alert_list},
    "DatabaseStatistics": {
        "dbstats": databases.dbstats,
        "xact_tendency": databases.xact_tendency,
        "dbsize_tendency": databases.dbsize_tendency,
        "db_rusage": databases.db_rusage,
        "recovery_conflicts": databases.recovery_conflicts,
        "wait_sampling_by_database": waits.wait_sampling_by_database,
        "replication_slots": replication.replication_slots_report,
    },
    "InstanceActivity": {
        "wal_stats": instance.wal_stats,
        "wal_tendency": instance.wal_tendency,
        "stat_wal": instance.stat_wal,
        "proc_tendency": instance.proc_tendency_with_average,
        "bgwriter_stats": instance.bgwriter_stats,
        "xid_tendency": instance.xid_tendency,
        "ht_info": instance.ht_info,
        "wait_sampling_by_instance": waits.wait_sampling_by_instance,
    },
    "OSResourceUsage": {
        "cpu_loadavg": resources.cpu_loadavg_with_average,
        "io_usage": resources.io_usage,
        "io_usage_tendency": resources.io_usage_tendency,
        "memory_tendency": resources.memory_tendency,
    },
    "DiskUsage": {
        "disk_usage_tablespace": resources.disk_usage_tablespace,
        "disk_usage_table": _limited(relations.disk_usage_table, relations.TOP_DISK_USAGE),
    },
    "LongTransactions": {
        "long_transactions": _limited(maintenance.long_transactions, maintenance.TOP_LONG_TRANSACTIONS)
    },
    "NotableTables": {
        "heavily_updated_tables": _limited(relations.heavily_updated_tables, relations.TOP_UPDATED),
        "heavily_accessed_tables": _limited(relations.heavily_accessed_tables, relations.TOP_ACCESSED),
        "low_density_tables": _limited(relations.low_density_tables, relations.TOP_LOW_DENSITY),
        "correlation": relations.correlation,
    },
    "CheckpointActivity": {"checkpoint_activity": maintenance.checkpoint_activity},
    "AutovacuumActivity": {
        "autovacuum_activity": _qualified(maintenance.autovacuum_activity),
        "autovacuum_activity2": _qualified(maintenance.autovacuum_activity2),
        "autovacuum_wal_activity": _qualified(maintenance.autovacuum_wal_activity),
        "autovacuum_index_activity": _qualified(maintenance.autovacuum_index_activity),
        "autoanalyze_stats": _qualified(maintenance.autoanalyze_stats),
    },
    "QueryActivity": {
        "functions": _limited(statements.query_functions, statements.TOP_QUERIES),
        "statements": _limited(statements.query_statements, statements.TOP_QUERIES),
        "statements_rusage": _limited(statements.query_statements_rusage, statements.TOP_QUERIES),
        "plans": _limited(statements.query_plans, statements.TOP_QUERIES),
        "wait_sampling": waits.wait_sampling,
    },
    "LockConflicts": {"lock_activity": _limited(maintenance.lock_activity, maintenance.TOP_LOCKS)},
    "ReplicationActivity": {"replication_status": replication.replication_status},
    "SettingParameters": {"setting_parameters": relations.setting_parameters},
    "SchemaInformation": {
        "schema_info_tables": relations.schema_info_tables,
        "schema_info_indexes": relations.schema_info_indexes,
    },
    "Profiles": {"profiles": maintenance.profiles},
    "HardwareInformation": {"cpuinfo": hardware.cpuinfo, "meminfo": hardware.meminfo},
}
ALL = "All"
# Prefixes are tried in this order, so "D" means DatabaseStatistics.
LOOKUP = [
    "Summary", "DatabaseStatistics", "InstanceActivity", "OSResourceUsage", "DiskUsage", "LongTransactions",
    "NotableTables", "CheckpointActivity", "AutovacuumActivity", "QueryActivity", "LockConflicts",
    "ReplicationActivity", "SettingParameters", "SchemaInformation", "Alert", "Profiles", "HardwareInformation",
    ALL,
]


def find_report(report_id: str | None) -> str:
    """Full id for a case-insensitive prefix; nothing given means all."""
    if report_id is None:
        return ALL
    wanted = report_id.strip().lower()
    for name in LOOKUP:
        if wanted and name.lower().startswith(wanted):
            return name
    raise ValueError(f"invalid report ID: '{report_id}'")


def report(repo: Repository, report_id: str | None, begin: int, end: int) -> dict[str, DataFrame]:
    """Lazy section frames of one report (all sections for ``All``)."""
    name = find_report(report_id)
    chosen = SECTIONS if name == ALL else {name: SECTIONS[name]}
    return {s: build(repo, begin, end) for group in chosen.values() for s, build in group.items()}


def _scopes(repo: Repository, snaps: DataFrame) -> DataFrame:
    # count snapshots per instance before the instance row is attached
    spans = snaps.groupBy("instid").agg(F.min("snapid").alias("begin"), F.max("snapid").alias("end"))
    owner = repo.table("instance").select("instid", "hostname", "port", "pg_version")
    return (
        spans.join(owner, "instid", "left")
        .orderBy(asc("instid"))
        .select("instid", "hostname", "port", "pg_version", "begin", "end")
    )


def report_scope_by_snapid(repo: Repository, begin: int = SNAPID_MIN, end: int = SNAPID_MAX) -> DataFrame:
    return _scopes(repo, repo.table("snapshot").where(F.col("snapid").between(begin, end)))


def report_scope_by_time(repo: Repository, since, until) -> DataFrame:
    rounded = to_second(F.col("time"))
    window = rounded.between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp"))
    return _scopes(repo, repo.table("snapshot").where(window))


def reportable(scopes: DataFrame, instid: int | None = None) -> DataFrame:
    """Scopes that cover more than one snapshot, of one instance if asked."""
    kept = scopes.where(F.col("begin") != F.col("end"))
    return kept if instid is None else kept.where(F.col("instid") == instid)


def run_reports(
    repo: Repository, report_id: str | None, scopes: DataFrame, instid: int | None = None
) -> Iterator[tuple[int, dict[str, DataFrame]]]:
    """Section frames per instance.  Only scope rows (one per instance) come to the driver.

    For the reports of :data:`tidemark.plans.fleet.REPORTS`, :func:`fleet_reports` needs one plan for all servers.
    """
    for scope in reportable(scopes, instid).toLocalIterator():
        yield scope["instid"], report(repo, report_id, scope["begin"], scope["end"])


def fleet_reports(repo: Repository, scopes: DataFrame) -> dict[str, DataFrame]:
    """Reports over all scopes at once, each one lazy frame with the server's ``instid``."""
    given = fleet.Fleet(repo, reportable(scopes))
    return {name: build(given) for name, build in fleet.REPORTS.items()}


def snapshot_list(repo: Repository, instid: int | None = None) -> DataFrame:
    snaps = repo.table("snapshot")
    if instid is not None:
        snaps = snaps.where(F.col("instid") == instid)
    owner = repo.table("instance").select("instid", "hostname", "port")
    return (
        snaps.join(owner, "instid", "left")
        .orderBy("snapid")
        .select(
            "snapid",
            "instid",
            "hostname",
            "port",
            to_second(F.col("time")).alias("time"),
            "comment",
            seconds_rounded(F.col("exec_time")).alias("exec_time"),
            size_pretty(F.col("snapshot_increase_size")).alias("size"),
        )
    )


def snapshot_size(repo: Repository) -> DataFrame:
    """Snapshots and stored size per instance, and a ``Total`` row."""
    figures = [F.count(F.lit(1)).alias("snapshots"), F.sum("snapshot_increase_size").alias("bytes")]
    per = (
        repo.table("snapshot")
        .groupBy("instid")
        .agg(*figures, F.max("snapid").alias("last_snapid"), to_second(F.max("time")).alias("last_time"))
    )
    owner = repo.table("instance").select("instid", "name", "hostname", "port")
    rows = per.join(owner, "instid", "left")
    total = rows.agg(F.sum("snapshots").alias("snapshots"), F.sum("bytes").alias("bytes")).withColumn(
        "name", F.lit("Total")
    )
    return (
        rows.unionByName(total, allowMissingColumns=True)
        .orderBy(asc("instid"))
        .select(
            "instid", "name", "hostname", "port", "snapshots", size_pretty_nearest(F.col("bytes")).alias("size"),
            "last_snapid", "last_time",
        )
    )
