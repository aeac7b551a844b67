"""SimHash near-duplicates with BK-trees over sharded fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.graph import components, unite

BITS = 64
SHARD = 4096  # fingerprints in one tree at most
FRONTIER = 1 << 21  # (query, node) pairs held at once

_DISTANCES = np.int64(BITS + 1)


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of one text: shingles of ``shingle`` words, each hashed by XXH64; no word gives zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())
        hashes = [digest(joined[a:b], seed) for a, b in spans]
    out = np.zeros(BITS, dtype=np.int64)
    array = np.array(hashes, dtype="<u8")
    for i in range(0, len(array), 1 << 16):
        bits = np.unpackbits(array[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(out * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` of whole texts, ``fp`` as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            found = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


class Forest:
    """BK-trees of many shards, built and searched level by level on arrays.

    ``shard`` is sorted; the members of a shard are distinct.  A shard's first member is its root.  A child
    hangs on its parent by their integer Hamming distance, one child per distance; later members of the same
    distance go down into that child.
    """

    def __init__(self, shard: np.ndarray, fp: np.ndarray) -> None:
        self.fp, self.root = fp, np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
        self.sizes = np.diff(np.concatenate((self.root, [len(fp)])))
        rest = np.setdiff1d(np.arange(len(fp)), self.root, assume_unique=True)
        parent = np.repeat(self.root, self.sizes)[rest]
        edges, child = [], []
        while len(rest):
            key = parent * _DISTANCES + np.bitwise_count(fp[rest] ^ fp[parent])
            own, first, back = np.unique(key, return_index=True, return_inverse=True)  # first: earliest member
            edges.append(own)
            child.append(rest[first])
            parent = rest[first][back]
            stay = np.ones(len(rest), dtype=bool)
            stay[first] = False
            rest, parent = rest[stay], parent[stay]
        self.edges = np.concatenate(edges) if edges else np.zeros(0, dtype=np.int64)
        order = np.argsort(self.edges, kind="stable")
        self.edges = self.edges[order]
        self.child = np.concatenate(child)[order] if child else np.zeros(0, dtype=np.int64)

    def search(self, tree: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query index, member index) within ``radius``, query i searching the tree number ``tree[i]``.

        From a node at distance d only edges d - radius to d + radius are followed.
        """
        bound = np.cumsum(self.sizes[tree])
        start = 0
        while start < len(tree):
            base = bound[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(bound, base + FRONTIER, side="right")))
            query, node = np.arange(start, stop), self.root[tree[start:stop]]
            hits_q, hits_n = [], []
            while len(query):
                d = np.bitwise_count(fp[query] ^ self.fp[node]).astype(np.int64)
                near = d <= radius
                hits_q.append(query[near])
                hits_n.append(node[near])
                low = np.searchsorted(self.edges, node * _DISTANCES + np.maximum(d - radius, 0))
                high = np.searchsorted(self.edges, node * _DISTANCES + np.minimum(d + radius, BITS), side="right")
                n = high - low
                query = np.repeat(query, n)
                node = self.child[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
            yield np.concatenate(hits_q), np.concatenate(hits_n)
            start = stop


def _shard_links(radius: int):
    """Tree search in runs of whole shards; of the links found it passes on those that join sets, one per member."""

    def links(key: np.ndarray, chunk: np.ndarray, low: np.ndarray, high: np.ndarray, fp: np.ndarray, rep: np.ndarray):
        in_tree = chunk == low
        probes = (chunk == high) & (~in_tree | (low == high))
        members, asking = np.flatnonzero(in_tree), np.flatnonzero(probes)
        forest = Forest(key[members], fp[members])
        known = key[members][forest.root] if len(members) else key[:0]
        tree = np.searchsorted(known, key[asking])
        there = tree < len(known)
        there[there] = known[tree[there]] == key[asking][there]
        asking, tree = asking[there], tree[there]
        parent = np.arange(len(key))
        for q, n in forest.search(tree, fp[asking], radius):
            unite(parent, asking[q], members[n])
        linked = np.flatnonzero(parent != np.arange(len(key)))
        return rep[linked], rep[parent[linked]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        names = ["shard", "fp", "chunk", "low", "high", "rep"]

        def flush(columns: list[np.ndarray]):
            shard, fp, chunk, low, high, rep = columns
            cut = (np.diff(shard) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
            a, b = links(np.concatenate(([0], np.cumsum(cut))), chunk, low, high, fp.view(np.uint64), rep)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            new = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            columns = [np.concatenate(x) for x in zip(*held, new)] if held else new
            same = np.ones(len(columns[0]), dtype=bool)
            for i in (0, 3, 4):
                same &= columns[i] == columns[i][-1]
            whole = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if whole:
                yield flush([c[:whole] for c in columns])
            held = [[c[whole:] for c in columns]]
        if held:
            yield flush([np.concatenate(x) for x in zip(*held)])

    return run


def blocks_for(n: int, radius: int, shard: int = SHARD) -> int:
    """Smallest number of bit blocks whose keys leave about ``shard`` / 16 or fewer fingerprints in a shard on average."""
    blocks = radius + 1
    while blocks < 2 * radius and n > (shard >> 4) << (BITS * (blocks - radius) // blocks):
        blocks += 1
    return blocks


def near_links(classes: DataFrame, radius: int, shard: int = SHARD) -> DataFrame:
    """Links ``(a, b)`` that join all members of ``classes(fp, rep)`` whose fingerprints differ in ``radius`` bits or fewer.

    The 64 bits are cut into blocks; two fingerprints within the radius agree on at least ``blocks - radius`` of
    them, so they meet in the shard of that choice of blocks.  The number of blocks follows the number of
    fingerprints, so shards stay small at any size, and results never depend on it.  A shard beyond ``shard``
    members is cut into chunks, and each chunk's tree is sent to every chunk of the shard: trees stay bounded
    and a hot shard is spread over many tasks.
    """
    n = classes.count()
    blocks = blocks_for(n, radius, shard)
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in chosen)
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    assert len(masks) == comb(blocks, radius)
    choice = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(masks)]))
    rows = classes.withColumn("choice", choice).select(
        "fp", "rep", F.xxhash64(F.col("choice.i"), F.col("fp").bitwiseAND(F.col("choice.m"))).alias("shard")
    )
    hot = rows.groupBy("shard").agg(F.count("*").alias("size")).where(F.col("size") > shard)
    hot = hot.select("shard", F.ceil(F.col("size") / shard).cast("int").alias("chunks"))
    rows = rows.join(hot, "shard", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select(
        "shard", "fp", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "rep"
    )
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(n * len(masks) / 2_000_000))
    rows = rows.repartition(parts, "shard", "low", "high").sortWithinPartitions("shard", "low", "high", "fp")
    return rows.mapInArrow(_shard_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """Group whole texts by SimHash: ``doc_id, fingerprint, component_id, kept``.

    Words are lower-cased (A-Z) and cut at white space; a text without words (null, empty, blank) has
    fingerprint zero and is linked like any other.  ``component_id`` is the smallest ``doc_id`` reachable by
    links of ``radius`` bits or fewer; ``kept`` marks that document.  Equal fingerprints are one node, so
    copies cost nothing in the search.  A repeated ``doc_id`` gives a row per input row; a null ``doc_id`` keeps
    its fingerprint, links nothing and has a null ``component_id`` and ``kept`` true.  Extra columns are ignored.
    An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, shingle, seed), "fingerprints").withColumn("doc_id", F.col("doc_id").cast("long"))
    classes = stored(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = components(near_links(classes, radius))
    # a document may carry several texts under one id, so classes that share a representative meet again here
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = prints.join(named, "fp", "left").withColumn("component_id", F.expr("IF(doc_id IS NULL, NULL, component_id)"))
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def representatives(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fp``: of every group of near texts the one of smallest ``doc_id``, then smallest fingerprint.

    Groups are of texts, not of ids: an id that carries several texts is in the group of each of them, so unrelated
    texts of one id stay apart.  Rows without an id are in no group.
    """
    rows = docs.where("doc_id IS NOT NULL")
    prints = stored(fingerprints(rows, shingle, seed).withColumn("doc_id", F.col("doc_id").cast("long")), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "classes")
    found = components(near_links(classes.select("fp", F.col("fp").alias("rep")), radius))
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    groups = named.groupBy(F.coalesce("component", "fp").alias("group")).agg(F.min(F.struct("doc_id", "fp")).alias("r"))
    return groups.select("r.doc_id", "r.fp")
