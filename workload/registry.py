"""Registration of checked queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import Repository, tune
from workload.frames import DerivedRepository, duckdb_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Portable column types: BIGINT, DOUBLE, VARCHAR, BOOLEAN."""
    columns = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.DateType):
            c = c.cast("string")
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def add(name: str, build: Callable[[Repository], DataFrame], sql: str | None) -> None:
    """Register a query over the derived repository and its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(build(DerivedRepository(tune(spark), sf_dir)))

    assert name not in QUERIES, name
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = duckdb_sql(sql)
