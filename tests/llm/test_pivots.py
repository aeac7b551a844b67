"""Pivot-permutation index against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_simhash import brute_components
from pyspark.sql import functions as F

from tidemark.llm import pivots
from tidemark.llm.pivots import near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, pivot string, n_links string"


def sample(seed=1, n=300, d=24):
    """Groups of near copies, exact copies, scaled copies and loners in three labels."""
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        base, label = rng.normal(size=d), int(rng.integers(0, 3))
        rows.append((base, label))
        for _ in range(int(rng.integers(0, 5))):
            rows.append((base + rng.normal(size=d) * rng.choice([0.0, 0.1, 0.3, 0.4]), int(rng.choice([label, label, label, 4]))))
    rows += [(rows[0][0] * 3, rows[0][1]), (rows[0][0][:10], rows[0][1])]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]
    hub = rows[5][1]
    rows += [(len(rows) + i, [x + 1e-3 * ((i * 7 + j) % 5) for j, x in enumerate(hub)], 7) for i in range(60)]
    return rows


def brute(rows, cosine=0.93):
    links = {}
    for i, (a, v, x) in enumerate(rows):
        for b, w, y in rows[:i]:
            if x is None or x != y or not v or not w or len(v) != len(w):
                continue
            v_, w_ = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
            if np.isfinite(v_).all() and np.isfinite(w_).all() and v_.any() and w_.any():
                if v_ @ w_ / np.sqrt((v_ @ v_) * (w_ @ w_)) >= cosine:
                    links.setdefault(a, set()).add(b)
                    links.setdefault(b, set()).add(a)
    return links


@pytest.mark.parametrize("size", [2048, 9])
def test_links_of_whole_table(spark, size):
    rows = sample()
    want = brute(rows)
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(4)
    got = {r.vec_id: r for r in near_duplicates(docs, size=size).collect()}
    assert len(got) == len(rows)
    found, total = sum(r.n_links for r in got.values()), sum(map(len, want.values()))
    assert all(got[i].n_links <= len(want.get(i, ())) for i in got)
    assert total * 0.97 <= found <= total
    if found == total:
        parent = {i: i for i in got}
        for _ in range(len(rows)):
            new = {i: min([parent[i], *(parent[j] for j in want.get(i, ()))]) for i in parent}
            if new == parent:
                break
            parent = new
        assert {i: got[i].component_id for i in got} == parent
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, -0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1),
        (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1),
        (1, [1.0, 0.0], 1), (12, [1.0, 0.0], 2),
    ]
    docs = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    linked = [(0, 4, None, True), (1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False)]
    assert got == linked + [(i, 0, i, True) for i in range(4, 13)]
    assert near_duplicates(docs.limit(0)).collect() == []


def test_links_inside_a_hot_group_of_near_copies(spark):
    """Two thirds of the rows are distinct near copies: dense reference points would tell them apart by noise."""
    rng = np.random.default_rng(11)
    center = rng.normal(size=64)
    near = center + 0.25 * rng.normal(size=(4000, 64))
    v = np.vstack((near, rng.normal(size=(2000, 64)))).astype(np.float32)
    docs = spark.createDataFrame([(i, x.tolist(), 1, "", "") for i, x in enumerate(v)], SCHEMA).repartition(4)
    got = {r.vec_id: r.n_links for r in near_duplicates(docs).select("vec_id", "n_links").collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(axis=1) - 1
    assert want.sum() > 1_000_000
    assert [got[i] for i in range(len(v))] == want.tolist()


def test_helper_components():
    assert brute_components([1, 2, 3], [0, 1, 255], 2) == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("share", [0.0, 0.8])
def test_vectors_that_share_a_direction(spark, share):
    """40 000 vectors of a given mean cosine: planted near pairs are linked, and few pairs are compared."""
    rng = np.random.default_rng(8)
    n, d, planted = 40_000, 64, 1500
    axis = rng.normal(size=d)
    x = np.sqrt(share) * axis / np.linalg.norm(axis) + np.sqrt((1 - share) / d) * rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    of = rng.choice(n, planted, replace=False)
    e = rng.normal(size=(planted, d))
    e -= (e * x[of]).sum(axis=1, keepdims=True) * x[of]
    near = 0.945 * x[of] + np.sqrt(1 - 0.945**2) * e / np.linalg.norm(e, axis=1, keepdims=True)
    rows = np.vstack([x, near]).astype(np.float32)
    table = pa.table({"vec_id": np.arange(len(rows)), "embedding": pa.array(list(rows), pa.list_(pa.float32())), "label": np.zeros(len(rows), dtype=np.int64)})
    frame = spark.createDataFrame(table).repartition(8)
    got = {r.vec_id: r.component_id for r in pivots.near_duplicates(frame).collect()}
    assert np.mean([got[n + i] == got[int(b)] for i, b in enumerate(of)]) >= 0.97
    classes = frame.select(F.col("vec_id").alias("rep"), F.lit(1).alias("copies"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    points = pivots.reference_points(classes, len(rows))
    described = next(iter(pivots._describe(points, pivots.DEPTH)(iter([classes.limit(6000).toArrow().combine_chunks().to_batches()[0]]))))
    has = np.zeros((len(described), len(points[d][1])), dtype=np.float32)
    np.put_along_axis(has, np.array(described.column("near").to_pylist()), 1, axis=1)
    assert (has[:500] @ has.T >= pivots.SHARED).mean() < 0.05


def test_tiny_and_huge_numbers(spark):
    rows = [(1, [1e-200, 2e-200], "a"), (2, [1e-199, 2e-199], "a"), (3, [1e200, 2e200], "a"), (4, [2e-200, -1e-200], "a"), (5, [5e-324, 0.0], "b"), (6, [1.0, 0.0], "b")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_duplicates(frame).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5)}
