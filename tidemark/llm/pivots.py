"""Embedding near-duplicates through a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.graph import components, unite

MAX_PIVOTS = 1024  # reference points of one dimension at most: chosen from the bounded sample the index is fitted on
SPARE = 4  # sampled vectors per reference point wanted, since those near a chosen one are skipped
PER_PIVOT = 40  # vectors per reference point aimed at
DEPTH = 16  # nearest reference points that describe a vector
NEAREST = 0.35  # cosine from the centre up to which reference points never count as close to each other
SHARED = 2  # reference points two vectors must share to be compared
LIST = 2048  # members of an inverted list handled at once


def _finite(column: str):
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~bad & F.exists(column, lambda x: x != 0)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1 (zero stays zero), whatever the size of their numbers."""
    v = v / np.maximum(np.abs(v).max(axis=1, keepdims=True), np.finfo(np.float64).tiny)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _spread(v: np.ndarray, close: float, most: int) -> list[int]:
    """Unit rows of which no two have a cosine of ``close`` or more, ``most`` at most."""
    chosen, taken = [], np.zeros(len(v), dtype=bool)
    for i in range(len(v)):
        if not taken[i] and len(chosen) < most:
            chosen.append(i)
            taken |= v @ v[i] >= close
    return chosen


def _spacing(v: np.ndarray, centre: np.ndarray, cosine: float) -> float:
    """Cosine, seen from the centre, from which on a sampled vector is too close to a chosen point.

    That is twice the link radius there, as long as it is closer than most pairs are.
    """
    width = float(((v - centre) ** 2).sum(axis=1).mean())
    radius = 1 - (1 - cosine) / width if width > 0 else 1.0
    half = len(v) // 2
    pairs = _unit(v[: min(half, 512)] - centre) @ _unit(v[half : half + 512] - centre).T
    most = float(np.quantile(pairs, 0.88)) if pairs.size else 0.0  # a third of near copies is a ninth of the pairs
    twice, usual = 2 * radius**2 - 1 if radius > 0 else -1.0, 2 * cosine**2 - 1
    return max(twice, min(max(most, NEAREST), max(usual, NEAREST)))


def reference_points(
    vectors: DataFrame, n: int, limit: int = MAX_PIVOTS, per_pivot: int = PER_PIVOT, cosine: float = 0.93
) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Centre and unit reference points by dimension, from the vectors whose hashed id comes first.

    Vectors are seen from the sample's mean: embeddings often share a direction, which would make all of them neighbours of the
    same points.  The points' number follows the number of vectors up to ``limit``.  A vector too close to a chosen point
    is skipped, so a group of near copies has few points however many rows it holds: were the points as dense as
    the rows, its members would be told apart by noise and share none.  A dimension that the sample misses uses the axes.
    """
    wanted = int(min(limit, max(4 * DEPTH, n // per_pivot)))
    sample = vectors.orderBy(F.xxhash64("rep"), "rep").limit(SPARE * wanted).select("vector").toArrow()
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    rows = pa.concat_arrays(sample.column("vector").chunks) if sample.num_rows else pa.array([], pa.list_(pa.float64()))
    sizes = np.diff(rows.offsets.to_numpy())
    flat, at = rows.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        v = _unit(flat[at[sizes == d][:, None] + np.arange(d)].astype(np.float64))
        apart = v[_spread(v, cosine, len(v))]  # near copies count once, or a hot group would be the centre
        centre = apart.mean(axis=0) if len(apart) > 4 * DEPTH else np.zeros(d)
        close = _spacing(apart, centre, cosine)
        v = _unit(v - centre)
        found[d] = centre, v[_spread(v, close, wanted)]
    return found


def _describe(pivots: dict[int, tuple[np.ndarray, np.ndarray]], depth: int):
    """Adds to each vector its nearest reference points, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            at = np.cumsum(sizes) - sizes
            near: list = [None] * len(sizes)
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                centre, points = pivots.get(int(d), (np.zeros(int(d)), np.eye(int(d), dtype=np.float64)[:MAX_PIVOTS]))
                for some in np.array_split(rows, ceil(len(rows) / 2048)):
                    close = _unit(_unit(flat[at[some][:, None] + np.arange(d)].astype(np.float64)) - centre) @ points.T
                    k = min(depth, len(points))
                    first = np.argpartition(-close, k - 1, axis=1)[:, :k]
                    order = np.argsort(-np.take_along_axis(close, first, axis=1), axis=1, kind="stable")
                    for row, found in zip(some.tolist(), np.take_along_axis(first, order, axis=1).astype(np.int32)):
                        near[row] = found
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("label", "rep", "copies", "vector")), pa.array(near, pa.list_(pa.int32()))],
                ["label", "rep", "copies", "vector", "near"],
            )

    return run


def _matches(pivot: int, vectors: np.ndarray, near: np.ndarray, left: np.ndarray, right: np.ndarray, shared: int, cosine: float):
    """Linked index pairs between members ``left`` and ``right`` of one inverted list.

    Candidates share ``shared`` reference points or more, or all where a dimension has fewer.  A pair is judged in
    the list of its smallest shared point only, so it is met once.
    """
    own, shared = left is right, min(shared, near.shape[1])
    names, column = np.unique(near[np.concatenate((left, right))], return_inverse=True)
    column = column.reshape(len(left) + len(right), -1)
    has = np.zeros((len(column), len(names)), dtype=np.float32)
    np.put_along_axis(has, column, 1, axis=1)
    low = names < pivot
    for i in range(0, len(left), 512):
        a, b = has[i : min(i + 512, len(left))], has[len(left) :]
        fit = (a @ b.T >= shared) & (a[:, low] @ b[:, low].T == 0)
        if own:
            fit &= np.arange(i, i + len(a))[:, None] < np.arange(len(b))[None, :]
        x, y = np.nonzero(fit)
        for j in range(0, len(x), 1 << 16):
            p, q = left[i + x[j : j + (1 << 16)]], right[y[j : j + (1 << 16)]]
            ok = np.einsum("ij,ij->i", vectors[p], vectors[q]) >= cosine
            yield p[ok], q[ok]


def _links(shared: int, cosine: float):
    """Verifies whole inverted lists; per member the copies linked to it and the set it falls into."""

    def verify(list_: np.ndarray, pivot, chunk, low, high, copies, rep, vectors: list[np.ndarray], near: list[np.ndarray]):
        parent, linked = np.arange(len(rep)), np.zeros(len(rep), dtype=np.int64)
        edges = np.flatnonzero(np.concatenate(([True], list_[1:] != list_[:-1], [True])))
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a < 2:
                continue
            local = np.arange(b - a)
            v = _unit(np.array([vectors[i] for i in range(a, b)], dtype=np.float64))
            p = np.array([near[i] for i in range(a, b)])
            c = chunk[a:b]
            left = local[c == low[a]]
            right = left if low[a] == high[a] else local[c == high[a]]
            for x, y in _matches(pivot[a], v, p, left, right, shared, cosine):
                np.add.at(linked, a + x, copies[a + y])
                np.add.at(linked, a + y, copies[a + x])
                unite(parent, a + x, a + y)
        met = np.flatnonzero(linked)
        return pa.RecordBatch.from_arrays([pa.array(rep[met]), pa.array(linked[met]), pa.array(rep[parent[met]])], ["rep", "n", "root"])

    names = ["list", "pivot", "chunk", "low", "high", "copies", "rep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            lists = [list(batch.column(n).to_numpy(zero_copy_only=False)) for n in ("vector", "near")]
            if held:
                now, lists = [np.concatenate(x) for x in zip(held[0], now)], [x + y for x, y in zip(held[1], lists)]
            same = (now[0] == now[0][-1]) & (now[3] == now[3][-1]) & (now[4] == now[4][-1])
            whole = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if whole:
                yield flush([x[:whole] for x in now], [x[:whole] for x in lists])
            held = [x[whole:] for x in now], [x[whole:] for x in lists]
        if held:
            yield flush(*held)

    def flush(now, lists):
        key, pivot, chunk, low, high, copies, rep = now
        cut = (np.diff(key) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
        return verify(np.concatenate(([0], np.cumsum(cut))), pivot, chunk, low, high, copies, rep, *lists)

    return run


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.93, depth: int = DEPTH, shared: int = SHARED, limit: int = MAX_PIVOTS, size: int = LIST
) -> DataFrame:
    """Links between vectors of one label: ``vec_id, n_links, component_id, kept`` for ``vectors(vec_id, embedding, label)``.

    Every vector is described by its ``depth`` nearest reference points (cosine; a bounded sample supplies
    at most ``limit`` points of a dimension, spread beyond the link radius, and their centre) and entered into the inverted list of each, by label.  Vectors that
    share ``shared`` points or more are candidates; their cosine is then computed in double precision.
    Lists beyond ``size`` members are cut into chunks that meet pairwise, so no task holds more than two.

    Equal vectors of a label are one entry with a number of copies.  Null, zero or non-finite vectors and null labels
    link with nothing: ``n_links`` 0, ``component_id`` the own id, ``kept`` true.  Vectors of different length never link.
    A repeated ``vec_id`` gives a row per input row.  A row with a null
    id counts as a copy of an equal vector that has one; else it links nothing, and its ``component_id`` may be null.  Extra columns are ignored; an empty table gives an empty result.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").alias("label"),
        F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vector"),
    )
    good = _finite("vector") & F.col("label").isNotNull()
    # rows of equal label and vector: addressed by a hash and told apart by the vector itself
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("key", F.xxhash64("label", "vector"))
    spark = vectors.sparkSession
    classes = stored(
        rows.where("good").groupBy("label", "key", "vector")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")),
        "classes",
    )
    known = classes.where("rep IS NOT NULL")
    n = known.count()
    points = reference_points(known, n, limit, cosine=cosine)
    described = known.mapInArrow(
        _describe(points, depth),
        f"label {classes.schema['label'].dataType.simpleString()}, rep long, copies long, vector array<double>, near array<int>",
    )
    entries = stored(described, "described").withColumn("dim", F.size("vector"))
    entries = entries.withColumn("pivot", F.explode("near")).withColumn("list", F.xxhash64("label", "dim", "pivot"))
    hot = entries.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > size)
    # written apart: where it is small, as is usual, its size is known and vectors need not move for this join
    hot = stored(hot.select("list", F.ceil(F.col("n") / size).cast("int").alias("chunks")), "hot")
    entries = entries.join(hot, "list", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    entries = entries.withColumn("chunk", F.pmod(F.xxhash64(F.lit(7), "rep"), F.col("chunks")).cast("int"))
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    entries = entries.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
    columns = ["list", "pivot", "chunk", "low", "high", "copies", "rep", F.col("vector").cast("array<float>").alias("vector"), "near"]
    exact = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    columns[7] = columns[7] if exact else "vector"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(n * depth / 200_000))
    entries = entries.select(*columns).repartition(parts, "list", "low", "high").sortWithinPartitions("list", "low", "high", "rep")
    links = stored(entries.mapInArrow(_links(shared, cosine), "rep long, n long, root long"), "links")
    found = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    sums = links.groupBy("rep").agg(F.sum("n").alias("n"))
    named = (
        classes.join(sums, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "key", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component"))
    )
    bare = rows.select("vec_id", "label", F.when(F.col("good"), F.col("key")).alias("key"), "vector")
    out = bare.join(named, ["label", "key", "vector"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
