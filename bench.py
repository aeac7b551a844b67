"""Wall time of the headline queries; prints one JSON line.

``queries`` time a report with the derivation of its repository.  ``stored`` writes some of the derived tables once
(``write``) and times reports on them: the least and the greatest of three runs after a first one.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_ALL=1 to time every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark import build_session  # noqa: E402
from tidemark.plans import databases, relations, statements  # noqa: E402
from workload import QUERIES  # noqa: E402
from workload.frames import DerivedRepository  # noqa: E402
from workload.oracle import B, E  # noqa: E402
from workload.stored import _stored  # noqa: E402

STORED = {
    "dbstats": lambda r: databases.dbstats(r, B, E),
    "xact_tendency": lambda r: databases.xact_tendency(r, B, E),
    "heavily_updated_tables": lambda r: relations.heavily_updated_tables(r, B, E),
    "schema_info_tables": lambda r: relations.schema_info_tables(r, B, E),
    "query_statements": lambda r: statements.query_statements(r, B, E),
}

HEADLINE = [
    "dbstats", "xact_tendency", "db_rusage", "wal_stats", "cpu_loadavg_average", "io_usage", "io_usage_tendency",
    "stat_io", "heavily_updated_tables", "heavily_accessed_tables", "low_density_tables", "schema_info_indexes",
    "modified_row_ratio", "autovacuum_activity", "autovacuum_wal_tendency", "autovacuum_index_activity",
    "autoanalyze_stats", "query_statements", "query_plans_report", "wait_sampling", "wait_sampling_by_database",
    "replication_activity", "lock_activity", "alert_union", "checkpoint_events", "autovacuum_events",
    "cancel_events", "activity_rollup", "wait_profile", "rusage_rollup", "ingest_relation_rollup",
]


def _seconds(run) -> float:
    started = time.perf_counter()
    run()
    return round(time.perf_counter() - started, 3)


def stored_times(spark, sf_dir: str) -> dict:
    found = []
    write = _seconds(lambda: found.append(_stored(DerivedRepository(spark, sf_dir), "database", "schema", "table", "column", "statement", "role")))
    out = {"write": write}
    for name, build in STORED.items():
        runs = [_seconds(lambda b=build: b(found[0]).write.format("noop").mode("overwrite").save()) for _ in range(4)]
        out[name] = [min(runs[1:]), max(runs[1:])]
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else [n for n in HEADLINE if n in QUERIES]
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start the JVM side once
    times = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    stored = stored_times(spark, sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_reports_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "stored": stored,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
