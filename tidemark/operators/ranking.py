"""Order, top-k and share-of-total, with the null order report users expect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def desc(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def asc(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def top(df: DataFrame, order: Sequence[Column], k: int | None) -> DataFrame:
    """Sorted result, or the first ``k`` rows by a top-k plan without a full sort."""
    ranked = df.orderBy(*order)
    return ranked if k is None else ranked.limit(k)


def share(part: Column, total: Column, kind: str = "decimal(10,3)") -> Column:
    whole = F.nullif(total.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return (part.cast("decimal(20,0)") * 100 / whole).cast(kind)


def top_shares(df: DataFrame, group: Sequence[str], measure: str, ties: Sequence[str], k: int) -> DataFrame:
    """First ``k`` rows of each group with ``ratio`` (percent of the group) and ``row_number``.

    Totals come from an ordinary aggregate and the rank filter becomes a group
    limit that trims each partition before the shuffle, so a group holding most
    of the rows still reaches the window with at most ``k`` rows per task.
    """
    order = [desc(measure), *[asc(t) for t in ties]]
    if not group:
        total = df.agg(F.sum(measure)).scalar()
        leaders = df.orderBy(*order).limit(k).withColumn("_total", total)
        ranked = leaders.withColumn("row_number", F.row_number().over(Window.orderBy(*order)))
    else:
        totals = df.groupBy(*group).agg(F.sum(measure).alias("_total"))
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        leaders = df.withColumn("row_number", rank).where(F.col("row_number") <= k)
        renamed = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_total")
        same = F.lit(True)
        for i, g in enumerate(group):
            same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
        ranked = leaders.join(renamed, same).drop(*[f"_g{i}" for i in range(len(group))])
    return ranked.withColumn("ratio", share(F.col(measure), F.col("_total"))).drop("_total")
