"""Mixing sources to target weights with exact quotas, split over output shards by a hypergeometric tree."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import n_words, stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0  # times its size a source may be taken
BLOCKS = 65536  # blocks of all sources together at most
PER_BLOCK = 64  # documents of a block aimed at, while that many blocks are enough
PER_SHARD = 2_000_000  # words of an output shard aimed at; as many shards as blocks at most


def targets(sizes: Sequence[float], weights: Sequence[float], most: float = MOST) -> np.ndarray:
    """Share of the total by weight; none above ``most`` times its size, the excess reshared by weight."""
    sizes, weights = np.array(sizes, dtype=float), np.array(weights, dtype=float)
    out, open_ = np.zeros(len(sizes)), np.ones(len(sizes), dtype=bool)
    rest = sizes.sum()
    while open_.any() and rest > 0:
        share = rest * weights[open_] / weights[open_].sum()
        above = share > most * sizes[open_]
        at = np.flatnonzero(open_)
        if not above.any():
            out[at] = share
            break
        full = at[above]
        out[full] = most * sizes[full]
        open_[full] = False
        rest = sizes.sum() - out.sum()
    return out


def splitting_tree(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source for each shard (shards x sources), summing to ``quota`` exactly.

    A node's quotas are split between its halves by a multivariate hypergeometric draw whose size is the share
    of the left half's shards, as if all blocks had been shuffled and dealt out.
    """
    quota = np.asarray(quota, dtype=np.int64)
    if shards == 1:
        return quota[None, :]
    left = shards // 2
    total = int(quota.sum())
    here = rng.multivariate_hypergeometric(quota, total * left // shards, method="marginals") if total else quota * 0
    return np.concatenate((splitting_tree(here, left, rng), splitting_tree(quota - here, shards - left, rng)))


def draw(sizes: list[list[int]], target: np.ndarray, shards: int, seed: int) -> list[tuple[int, int, int, int, list[int]]]:
    """Which blocks the mix takes: ``(source, block, whole draws, words of a further partial draw, shards)``.

    ``sizes[s][b]`` are the words of block b.  A source's blocks are permuted and drawn in that order, again from the
    start as often as the target needs; the last block drawn is taken in part, so the words taken meet the target
    rounded down.  The tree fixes how many draws of each source a shard gets, and disjoint runs of the
    draws fill them.
    """
    rng = np.random.default_rng(seed)
    drawn: list[list[tuple[int, int]]] = []
    for s, blocks in enumerate(sizes):
        size, own = np.array(blocks, dtype=np.int64), []
        order = np.concatenate([rng.permutation(np.flatnonzero(size > 0)), np.flatnonzero(size == 0)]).astype(int)
        wanted, total = int(target[s] + 1e-6), int(size.sum())
        while total and wanted > 0:
            for b in order.tolist():
                if size[b] == 0 or wanted <= 0:
                    continue
                own.append((b, int(min(size[b], wanted))))
                wanted -= int(size[b])
        drawn.append(own)
    plan = splitting_tree(np.array([len(x) for x in drawn], dtype=np.int64), shards, rng)
    rows: dict[tuple[int, int], list] = {}
    for s, own in enumerate(drawn):
        shard = np.repeat(np.arange(shards), plan[:, s])
        for (b, words), k in zip(own, shard.tolist()):
            row = rows.setdefault((s, b), [0, 0, []])
            if words == sizes[s][b]:
                row[0] += 1
            else:
                row[1] = words
            row[2].append(k)
    return [(s, b, *row) for (s, b), row in rows.items()]


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, shards: int | None = None, seed: int = 11,
        blocks: int = BLOCKS, per_block: int = PER_BLOCK) -> DataFrame:
    """The rows of ``docs(doc_id, text, source, ...)`` with ``size, source_size, target, taken, shards``.

    ``size`` counts words (null text: 0).  Sources in code point order, null last, weigh ``weights`` in turn; see
    ``targets``.  ``taken`` are the words the mix takes of a document, repeats counted: ``size`` for every whole draw
    of its block, and for a partial draw what is left of the quota when its turn comes.  ``shards`` lists the
    output shard of each draw of its block in order, a partial one last; empty texts are taken with none.

    Documents fall into blocks by a hash of id and text, so reruns agree and a hot source has many; only sums per
    block (``blocks`` at most, besides one per source) reach the driver.  Equal rows share a block and are told apart by
    row order in the partial draw, where they are interchangeable.  Extra columns pass through; an empty table
    gives an empty result.  Input columns called like a new one are replaced.
    """
    new = ("size", "source_size", "target", "taken", "shards")
    kept = [c for c in docs.columns if c not in new]
    rows = docs.select(*kept).withColumn("size", n_words(F.col("text").cast("string")))
    rows = rows.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")))
    rows = rows.withColumn("_turn", F.xxhash64(F.lit(seed), "doc_id", "text"))
    # the words of every text, counted once for both sums below
    counted = stored(rows.select("_key", "_turn", "size", "source"), "sizes")
    totals = counted.groupBy("_key").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.first("source", True).alias("source")).collect()
    # one row per source; null is '-', which no other key equals
    totals.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be", "surrogatepass")))
    n = sum(r.n for r in totals)
    count = [max(1, min(r.n // per_block, blocks * r.n // n)) for r in totals]
    target = targets([r.size for r in totals], [weights[i % len(weights)] for i in range(len(totals))], most)
    if shards is None:
        shards = int(min(blocks, 1 + target.sum() // PER_SHARD))
    spark = docs.sparkSession
    known = [(r["_key"], i, c, r["size"], float(t)) for i, (r, c, t) in enumerate(zip(totals, count, target))]
    sources = spark.createDataFrame(known, "_key string, _source int, _blocks int, source_size long, target double")
    if len(known) <= blocks:
        sources = F.broadcast(sources)  # ``blocks`` rows at most; more sources are joined by shuffle
    block = F.pmod("_turn", F.col("_blocks")).cast("int")
    rows = rows.join(sources, "_key", "left").withColumn("_block", block)
    sums = counted.join(sources, "_key").withColumn("_block", block).groupBy("_source", "_block").agg(F.sum("size").alias("size")).collect()
    sizes = [[0] * c for c in count]
    for r in sums:
        sizes[r["_source"]][r["_block"]] = r["size"]
    plan = spark.createDataFrame(draw(sizes, target, shards, seed), "_source int, _block int, _whole int, _part long, shards array<int>")
    if len(known) <= blocks:
        plan = F.broadcast(plan)  # ``2 * blocks`` rows at most; with more sources joined by shuffle
    rows = rows.join(plan, ["_source", "_block"], "left")
    # the one block of each source that is taken in part: words before a document, in hash order
    order = W.partitionBy("_source", "_block").orderBy("_order", "_turn", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    partial = F.coalesce(F.col("_part"), F.lit(0)) > 0
    some = rows.where(partial).withColumn("_order", F.xxhash64(F.lit(seed + 1), "_turn"))
    some = some.withColumn("_more", F.greatest(F.lit(0), F.least("size", F.col("_part") - F.coalesce(F.sum("size").over(order), F.lit(0)))))
    whole = rows.where(~partial).withColumn("_more", F.lit(0).cast("long"))
    out = whole.unionByName(some.drop("_order"))
    taken = F.col("size") * F.coalesce("_whole", F.lit(0)) + F.col("_more")
    return out.select(*kept, "size", "source_size", "target", taken.cast("long").alias("taken"),
                      F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))


def taken_rows(mixed: DataFrame, columns: Sequence[str], seed: int = 11) -> DataFrame:
    """The mix itself: ``columns`` of each document as often as its block was drawn, by output shard and shuffled inside.

    ``mixed`` is the result of :func:`mix`.  A copy carries the whole text; the last one of a partial draw its first words only,
    joined by single spaces.
    A document of which a draw takes no word is left out of it; wordless texts go.
    """
    whole = F.floor(F.col("taken") / F.col("size"))
    copies = F.transform(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size"))), lambda k: k.cast("int"))
    rows = mixed.where("taken > 0").withColumn("_copy", F.explode(copies))
    rest = F.col("taken") - whole * F.col("size")
    words = F.array_remove(F.split(F.col("text"), r"[\x20\x09-\x0D]+", -1), "")
    partial = (F.col("_copy") > whole) & (rest > 0)
    text = F.when(partial, F.array_join(F.slice(words, 1, rest.cast("int")), " ")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in columns:
        kind = mixed.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(partial, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    rows = rows.withColumn("_shard", F.element_at("shards", F.col("_copy")))
    rows = rows.withColumn("_turn", F.xxhash64(F.lit(seed), "_copy", "doc_id", "text"))
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionById(parts, F.pmod(F.col("_shard"), F.lit(parts)).cast("int")).sortWithinPartitions("_shard", "_turn")
    return rows.select(*columns)
