"""Mixing: targets, exact quotas, the splitting tree, reruns."""

import random
import re

import numpy as np
import pytest

from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string, lang string"


def test_targets_cap_and_reshare():
    assert mixing.targets([100, 100, 100], [5, 2, 1]).tolist() == pytest.approx([187.5, 75, 37.5])
    got = mixing.targets([10, 1000, 1000], [5, 2, 1])
    assert got[0] == 30 and got.sum() == pytest.approx(2010) and got[1] == pytest.approx(2 * got[2])
    assert mixing.targets([0, 5], [5, 2]).tolist() == [0, 5]
    assert mixing.targets([], []).tolist() == [] and mixing.targets([0], [1]).tolist() == [0]


def test_tree_is_exact_and_fair():
    rng = np.random.default_rng(1)
    quota = np.array([700, 20, 0, 281])
    plan = mixing.splitting_tree(quota, 7, rng)
    assert plan.shape == (7, 4) and (plan >= 0).all() and plan.sum(axis=0).tolist() == quota.tolist()
    assert plan.sum(axis=1).max() - plan.sum(axis=1).min() <= 3
    # shares follow a hypergeometric law: mean and spread of one shard's count
    draws = np.array([mixing.splitting_tree(np.array([30, 70]), 4, rng)[0, 0] for _ in range(3000)])
    assert draws.mean() == pytest.approx(7.5, abs=0.2) and draws.var() == pytest.approx(25 * 0.3 * 0.7 * 75 / 99, rel=0.15)


def corpus(seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        source = rng.choice(["a", "a", "a", "b", "c", None, "Z", "é"])
        rows.append((i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(0, 60))), source, "", "", ""))
    return rows + [(900, None, "b", "", "", ""), (None, "x y z", "c", "", "", ""), (3, rows[3][1], rows[3][2], "", "", ""), (901, "big " * 5000, "b", "", "", "")]


@pytest.mark.parametrize("blocks", [65536, 12])
def test_every_source_meets_its_target(spark, blocks):
    rows = corpus()
    frame = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(frame.repartition(3), blocks=blocks).collect()
    assert len(got) == len(rows)
    order = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(re.findall(r"\S+", t or "")) for _, t, s, *_ in rows if s == x) for x in order]
    want = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))])
    for x, size, target in zip(order, sizes, want):
        own = [r for r in got if r.source == x]
        assert {(r.source_size, round(r.target, 6)) for r in own} == {(size, round(target, 6))}
        assert sum(r.taken for r in own) == int(target + 1e-6)
        assert all(0 <= r.taken <= 3 * r.size for r in own)
        assert all(len(r.shards) >= -(-r.taken // r.size) for r in own if r.size)
    again = mixing.mix(frame.repartition(5), blocks=blocks).collect()
    key = lambda r: (r.doc_id or -1, r.taken, tuple(r.shards))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_empty_and_wordless(spark):
    frame = spark.createDataFrame([(1, "", None, "", "", ""), (2, None, "a", "", "", "")], SCHEMA)
    assert {(r.size, r.taken, r.target) for r in mixing.mix(frame).collect()} == {(0, 0, 0.0)}
    assert mixing.mix(frame.limit(0)).collect() == []
