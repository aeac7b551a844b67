"""Best-fit packing: against a plain version, invariants, odd rows."""

import random
import re

import pytest

from tidemark.llm import packing
from tidemark.llm.packing import cost, pack

SCHEMA = "doc_id long, text string, size string, piece string, start string"


def plain(sizes, lengths):
    bins, at, left = [], {}, sum(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = [(b["cap"] - b["used"] - sizes[i], k) for k, b in enumerate(bins) if b["cap"] - b["used"] >= sizes[i] and b["cap"] > b["used"]]
        if fit:
            k = min(fit)[1]
        else:
            cap = min((c for c in lengths if c >= sizes[i]), key=lambda c: (cost(c) / max(1, min(c, left)), c))
            bins.append({"cap": cap, "used": 0})
            k = len(bins) - 1
        at[i] = k
        bins[k]["used"] += sizes[i]
        left -= sizes[i]
    return [at[i] for i in range(len(sizes))], [min(c for c in lengths if c >= b["used"]) for b in bins]


@pytest.mark.parametrize("seed", range(20))
def test_pack_equals_plain_best_fit(seed):
    rng = random.Random(seed)
    lengths = rng.sample([16, 32, 64, 128, 512, 2048], rng.randrange(1, 5))
    sizes = [rng.randrange(0, max(lengths) + 1) for _ in range(rng.randrange(0, 150))]
    at, offset, final = pack(sizes, lengths)
    want, caps = plain(sizes, lengths)
    assert at == want and final == caps
    for b, cap in enumerate(final):
        spans = sorted((offset[i], sizes[i]) for i in range(len(sizes)) if at[i] == b)
        used = 0
        for o, s in spans:
            assert o == used
            used += s
        assert used <= cap and not any(used <= c < cap for c in lengths)


def test_several_lengths_cost_less_than_one():
    rng = random.Random(1)
    sizes = [min(8192, int(rng.lognormvariate(6, 1))) for _ in range(3000)]
    final = pack(sizes)[2]
    assert sum(map(cost, final)) < min(sum(map(cost, pack(sizes, [c])[2])) for c in packing.LENGTHS if c >= max(sizes))
    assert sum(sizes) / sum(final) > 0.95


def test_rows_are_packed_once(spark):
    rng = random.Random(2)
    texts = ["w " * rng.randrange(0, 90) for _ in range(300)] + [None, "", "a\tb\nc", "x " * 5003]
    rows = [(i, t, "", "", "") for i, t in enumerate(texts)] + [(None, "a b", "", "", "")] + [(5, "same text", "", "", "")] * 40
    got = packing.packed(spark.createDataFrame(rows, SCHEMA), (16, 64, 128), block=32, parts=3).collect()
    words = {}
    for i, t, *_ in rows:
        words.setdefault(i, []).append(len(re.findall(r"\S+", t or "")))
    assert sum(r["size"] for r in got) == sum(map(sum, words.values()))
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.start, r["size"]))
        assert r.start == r.piece * 128 and (r["size"] == 128 or r.start + r["size"] in words[r.doc_id])
    assert len(by[303]) == -(-5003 // 128) and len(by[5]) == 41 and by[300] == [(0, 0)] and by[None] == [(0, 2)]
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append(r)
    for rows_ in bins.values():
        caps, used = {r.sequence_length for r in rows_}, 0
        for r in sorted(rows_, key=lambda r: (r.offset, r["size"])):
            assert r.offset == used
            used += r["size"]
        assert len(caps) == 1 and caps <= {16, 64, 128} and used <= min(caps)
    assert packing.packed(spark.createDataFrame([], SCHEMA)).collect() == []


def test_fill_does_not_depend_on_the_session(spark):
    """Few pieces are packed together however many shuffle partitions are set, and ids that are all null spread."""
    rng = random.Random(8)
    rows = [(None, f"t{i} " + "w " * int(rng.lognormvariate(5, 1)), "", "", "") for i in range(4000)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "300")
        out = packing.packed(frame)
        got = out.collect()
        spread = [len(list(p)) for p in packing.packed(frame, block=500).rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    final = {r.sequence_id: r.sequence_length for r in got}
    assert len(got) == 4000 and sum(r["size"] for r in got) / sum(final.values()) > 0.99
    assert len(spread) == 8 and max(spread) < 2 * min(spread)
