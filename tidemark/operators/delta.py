"""Differences between cumulative counters.

Three shapes cover the reports:

* endpoint pair: one scan of two snapshots folded to a row per entity;
* series: each mark next to the previous mark of the same entity;
* registry: every entity seen in a range, from the range start to its own last mark.

All of them aggregate or window on the entity key, so the first two reduce map-side
and none builds a group that grows with the number of entities.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Snapshots per window group.  An entity has at most one row per snapshot, so a
# scope not longer than this bounds every group; longer scopes are cut into chunks.
CHUNK = 8192


def endpoint_pair(
    df: DataFrame,
    keys: Sequence[str],
    begin: int | Column,
    end: int | Column,
    counters: Sequence[str] = (),
    at_end: Sequence[str] = (),
    at_begin: Sequence[str] = (),
    presence: str = "end",
) -> DataFrame:
    """Fold the rows of two snapshots into one row per entity; the two may differ by row.

    ``counters`` become ``b_x`` and ``e_x``; ``at_end`` / ``at_begin`` keep only
    that side.  ``presence`` is ``end`` (left join of end to begin), ``both``
    (inner) or ``any`` (full outer).
    """
    is_b, is_e = F.col("snapid") == begin, F.col("snapid") == end
    folded = [F.max(F.when(is_b, F.col(c))).alias(f"b_{c}") for c in [*counters, *at_begin]]
    folded += [F.max(F.when(is_e, F.col(c))).alias(f"e_{c}") for c in [*counters, *at_end]]
    pair = (
        df.where(is_b | is_e if isinstance(begin, Column) else F.col("snapid").isin(begin, end))
        .groupBy(*keys)
        .agg(F.max(is_b.cast("int")).alias("in_begin"), F.max(is_e.cast("int")).alias("in_end"), *folded)
    )
    if presence == "end":
        pair = pair.where("in_end = 1")
    elif presence == "both":
        pair = pair.where("in_end = 1 AND in_begin = 1")
    return pair


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    order: str = "snapid",
    scope_length: int | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Add ``prev_x`` (value at the entity's previous row) for each column.

    ``scope_length`` is a proven limit on rows per entity.  Without one, or above
    ``chunk``, the order axis is cut into chunks: each chunk is windowed alone and
    its first row takes the last values of the entity's preceding chunk.  No window
    group then exceeds ``chunk`` order values, however long one entity's history is.
    """
    lagged = [F.lag(c).over(Window.partitionBy(*keys).orderBy(order)).alias(f"prev_{c}") for c in cols]
    if scope_length is not None and scope_length <= chunk:
        return df.select("*", *lagged)
    return _chunked_previous(df, list(keys), list(cols), order, F.floor(F.col(order) / F.lit(chunk)))


def _chunked_previous(
    df: DataFrame, keys: list[str], cols: list[str], order: str | Sequence[str], chunk_of: Column
) -> DataFrame:
    orders = [order] if isinstance(order, str) else list(order)
    cut = df.withColumn("_chunk", chunk_of)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*orders)
    here = cut.select(
        "*",
        F.row_number().over(inside).alias("_row"),
        *[F.lag(c).over(inside).alias(f"_lag_{c}") for c in cols],
    )
    # one summary row per entity and chunk, reduced map-side
    rank = F.struct(*orders) if len(orders) > 1 else F.col(orders[0])
    tails = cut.groupBy(*keys, "_chunk").agg(*[F.max_by(c, rank).alias(f"_tail_{c}") for c in cols])
    across = Window.partitionBy(*keys).orderBy("_chunk")
    carried = tails.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_chunk").alias("_carried_chunk"),
        *[F.lag(f"_tail_{c}").over(across).alias(f"_carry_{c}") for c in cols],
    )
    same = F.col("_chunk") == F.col("_carried_chunk")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return here.join(carried, same, "left").select(
        *[F.col(c) for c in df.columns],
        *[
            F.when(F.col("_row") == 1, F.col(f"_carry_{c}")).otherwise(F.col(f"_lag_{c}")).alias(f"prev_{c}")
            for c in cols
        ],
    )


def with_previous_in_time(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """:func:`with_previous` for rows ordered by a timestamp, cut by day."""
    day = F.unix_date(F.to_date(F.col(order[0])))
    return _chunked_previous(df, list(keys), list(cols), list(order), day)


def step(c: str, first: Column | None = None) -> Column:
    """``x - prev_x``; ``first`` replaces a missing previous value."""
    prev = F.col(f"prev_{c}")
    return F.col(c) - (prev if first is None else F.coalesce(prev, first))


def since_reset(end: Column, begin: Column, reset_end: Column, reset_begin: Column, null_reset: str = "end") -> Column:
    """Counter growth that honours a statistics reset between the two marks.

    Same reset time: difference.  Otherwise the end value counts from the reset.
    ``null_reset='difference'`` treats a never reset counter as continuous.
    """
    grown = F.when(reset_end == reset_begin, end - begin)
    if null_reset == "difference":
        grown = grown.when(reset_end.isNull(), end - F.coalesce(begin, F.lit(0)))
    return grown.otherwise(end)


def registry(
    df: DataFrame,
    keys: Sequence[str],
    begin: int | Column,
    counters: Sequence[str],
    texts: Sequence[str] = (),
    latest: Sequence[str] = (),
) -> DataFrame:
    """Entities seen in a scope: ``last`` snapshot, counters at ``begin`` and at ``last``.

    One pass replaces the lookup of the last mark and two joins back to the fact.
    """
    at_begin = F.col("snapid") == begin
    return df.groupBy(*keys).agg(
        F.max("snapid").alias("last"),
        *[F.max(F.when(at_begin, F.col(c))).alias(f"b_{c}") for c in counters],
        *[F.max_by(c, "snapid").alias(f"e_{c}") for c in [*counters, *latest]],
        *[F.max(c).alias(c) for c in texts],
    )
