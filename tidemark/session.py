"""Session defaults used by tests, the benchmark and small tools.

On a cluster the caller brings its own session; :func:`tune` only sets runtime
options that the reports rely on for identical results everywhere.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Options that may be changed on a running session.
RUNTIME_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_OPTIONS.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    app: str = "tidemark", master: str = "local[*]", shuffle_partitions: int = 8, **extra: str
) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        # Reports build hundreds of column expressions; do not record a call site for each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in {**RUNTIME_OPTIONS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
