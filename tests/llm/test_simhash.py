"""SimHash near-duplicates against brute force."""

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash
from tidemark.llm.graph import components
from tidemark.llm.simhash import Forest, blocks_for, near_duplicates, near_links

SCHEMA = "doc_id long, text string, fp string, rep int, component_id string"


def brute_print(text):
    words = [w for w in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in text or "").split(" ") if w]
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, prints, radius):
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in zip(ids, prints):
        for b, y in zip(ids, prints):
            if a < b and (x ^ y).bit_count() <= radius:
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    return {i: top(i) for i in ids}


def texts():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)] + ["Été", "ÀB", " x"]
    out = []
    for i in range(40):
        base = list(rng.choice(words, int(rng.integers(30, 400))))
        out.append(" ".join(base))
        for _ in range(int(rng.integers(0, 4))):
            near = list(base)
            near[int(rng.integers(0, len(near)))] = "changed"
            out.append("\n".join(near).upper() if rng.random() < 0.3 else "\t ".join(near))
    return [*out, out[0], out[0], "", None, "  \n", "one", "ONE", "one two three", "x " * 30000]


def test_matches_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in enumerate(rows)], SCHEMA)
    got = {r.doc_id: r for r in near_duplicates(docs.repartition(5)).collect()}
    prints = [brute_print(t) for t in rows]
    want = brute_components(range(len(rows)), prints, 4)
    assert len(got) == len(rows)
    for i in range(len(rows)):
        assert got[i].fingerprint == f"{prints[i]:016x}"
        assert got[i].component_id == want[i]
        assert got[i].kept == (want[i] == i)
    assert any(want[i] != i and prints[i] != prints[want[i]] for i in want)


def test_null_ids_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e", "", 1, ""), (7, "a b c d e", "", 1, ""), (7, "a b c d e", "", 1, "")], SCHEMA)
    got = near_duplicates(docs).collect()
    assert sorted(((r.doc_id or -1), r.component_id, r.kept) for r in got) == [(-1, None, True), (7, 7, True), (7, 7, True)]
    assert len({r.fingerprint for r in got}) == 1
    assert near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("radius, shard", [(4, 4096), (4, 5), (3, 2)])
def test_links_reach_all_neighbours(spark, radius, shard):
    """Small shards force more blocks, chunks and tree-to-chunk probes; sets stay the same."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base[:8]:
        for _ in range(20):
            for bit in rng.integers(0, 64, 3):
                b = b ^ np.uint64(1 << int(bit))
            prints.add(int(b))
    prints = sorted(prints)
    rows = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    links = near_links(spark.createDataFrame(rows, "fp long, rep long"), radius, shard)
    for a, b in links.collect():
        assert a != b
    got = dict(components(links).collect())
    want = brute_components(range(len(prints)), prints, radius)
    assert {i: got.get(i, i) for i in want} == want


def test_tree_search_is_exact():
    rng = np.random.default_rng(8)
    shard = np.sort(rng.integers(0, 6, 400))
    fp = rng.integers(0, 2**12, 400).astype(np.uint64)
    keep = np.unique(np.stack([shard.astype(np.uint64), fp]), axis=1, return_index=True)[1]
    shard, fp = shard[np.sort(keep)], fp[np.sort(keep)]
    forest = Forest(shard, fp)
    tree = np.searchsorted(shard[forest.root], shard)
    got = {(int(q), int(n)) for a, b in forest.search(tree, fp, 2) for q, n in zip(a, b)}
    want = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if shard[i] == shard[j] and (int(fp[i]) ^ int(fp[j])).bit_count() <= 2}
    assert got == want
    # children hang by distance, one per edge
    assert len(set(forest.edges.tolist())) == len(forest.edges)


def test_blocks_follow_size():
    assert blocks_for(1000, 4) == 5
    assert 5 < blocks_for(10**9, 4) <= 8
    assert simhash.blocks_for(10**15, 4) == 8


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 180)] + [(5, 5), (7, None)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 180)}}
