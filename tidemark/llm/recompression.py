"""Periodic runs of words by recompression: a run-length grammar answers exact extensions of grid candidates."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD
from tidemark.llm.words import mixed

LEAST = 6  # words of the shortest run
POWER = 4  # periods of the shortest run
GROUP = 1 << 18  # words handled together; a longer text is a group of its own
SLICE = 1 << 20  # grid points looked at together
ROUNDS = 96

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Grammar:
    """Run-length grammar of texts laid side by side, all levels in flat arrays.

    Level 0 is the given sequence (symbols >= 0; separators are negative and all different).  A round first replaces each
    block of equal neighbours by one symbol, then each pair of a left and a right symbol by one, where a hash of the round
    says which symbols are left.  Equal strings of words inside texts are thus parsed alike but for their ends, so a
    query walks a number of nodes logarithmic in its answer.
    """

    def __init__(self, symbols: np.ndarray):
        level = symbols.astype(np.int64)
        size = np.ones(len(level), dtype=np.int64)
        fresh = int(level.max(initial=0)) + 1
        texts = int((level < 0).sum())
        parts = {k: [] for k in ("sym", "size", "up", "head", "tail", "first", "last", "count")}
        base, below = 0, np.full(len(level), -1)
        parts["sym"].append(level)
        parts["size"].append(size)
        parts["first"].append(below)
        parts["last"].append(below)
        parts["count"].append(np.zeros(len(level), dtype=np.int64))
        for turn in range(ROUNDS):
            if len(level) <= 4 * texts:
                break
            for blocks in (True, False):
                if blocks:
                    joined = level[1:] == level[:-1]
                else:
                    right = (mixed(level.astype(np.uint64) * np.uint64(2 * ROUNDS) + np.uint64(turn)) & np.uint64(1)).astype(bool)
                    joined = ~right[:-1] & right[1:] & (level[:-1] >= 0) & (level[1:] >= 0)
                if not joined.any():
                    continue
                opens = np.concatenate(([True], ~joined))
                at = np.flatnonzero(opens)
                count = np.diff(np.append(at, len(level)))
                new, grown = level[at], size[at] * count if blocks else np.add.reduceat(size, at)
                many = count > 1
                second = count[many] if blocks else level[at[many] + 1]
                keys = np.stack((new[many], second), axis=1)
                order = np.lexsort((keys[:, 1], keys[:, 0]))
                step = np.concatenate(([0], np.any(keys[order][1:] != keys[order][:-1], axis=1).cumsum()))
                names = np.empty(len(order), dtype=np.int64)
                names[order] = fresh + step
                fresh += int(step[-1]) + 1
                new = new.copy()
                new[many] = names
                # the level below learns its parents
                owner = np.cumsum(opens) - 1
                top = base + len(level)
                parts["up"].append(top + owner)
                parts["head"].append(opens)
                parts["tail"].append(np.append(~joined, True))
                parts["sym"].append(new)
                parts["size"].append(grown)
                parts["first"].append(base + at)
                parts["last"].append(base + at + count - 1)
                parts["count"].append(count if blocks else np.zeros(len(at), dtype=np.int64))
                base, level, size = top, new, grown
        parts["up"].append(np.full(len(level), -1))
        parts["head"].append(np.zeros(len(level), dtype=bool))
        parts["tail"].append(np.zeros(len(level), dtype=bool))
        for name, found in parts.items():
            kind = bool if name in ("head", "tail") else np.int64 if name == "sym" else np.int32
            setattr(self, name, np.concatenate(found).astype(kind))

    def extension(self, left: np.ndarray, right: np.ndarray, step: int) -> np.ndarray:
        """Number of equal symbols of level 0 from positions ``left`` and ``right`` on, forwards (1) or backwards (-1)."""
        a, b = left.astype(np.int64), right.astype(np.int64)
        total = np.zeros(len(a), dtype=np.int64)
        edge, child = (self.head, self.first) if step > 0 else (self.tail, self.last)
        live = np.arange(len(a))
        while live.size:
            x, y = a[live], b[live]
            same = self.sym[x] == self.sym[y]
            px, py = self.up[x], self.up[y]
            climb = same & edge[x] & edge[y] & (self.sym[px] == self.sym[py])
            pass_by = same & ~climb
            cx, cy = child[x], child[y]
            # blocks of one symbol: the shorter one's copies are equal
            block = ~same & (self.count[x] > 0) & (self.count[y] > 0) & (self.sym[cx] == self.sym[cy])
            shared = np.where(block, np.minimum(self.count[x], self.count[y]), 0)
            total[live] += np.where(pass_by, self.size[x], 0) + shared * self.size[cx]
            a[live] = np.where(climb, px, np.where(pass_by, x + step, cx + step * shared))
            b[live] = np.where(climb, py, np.where(pass_by, y + step, cy + step * shared))
            live = live[same | (cx >= 0)]
        return total


def _grid(starts: np.ndarray, sizes: np.ndarray, power: int = POWER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and periods of the harmonic grid in slices: every other multiple of each period that a run may have."""
    most = sizes // power
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    points = (sizes[text] - 1) // (2 * period)
    ends = np.cumsum(points)
    at = 0
    while at < len(text):
        before = ends[at] - points[at]
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
        n = points[at:to]
        number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        q = np.repeat(period[at:to], n)
        yield np.repeat(starts[text[at:to]], n) + 2 * q * number, q
        at = to


def _candidates(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid points whose word comes again one and two periods later: at least one for every run of four periods."""
    for at, q in _grid(starts, sizes):
        word = ids[at]
        hit = np.flatnonzero(word == ids[at + q])
        hit = hit[word[hit] == ids[at[hit] + 2 * q[hit]]]
        if hit.size:
            yield at[hit], q[hit]


def find_runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Runs of every text, given as words: rows (start, length, period) by start, then period.

    A run is a stretch with smallest period q and at least max(6, 4 q) words that no neighbouring word extends.
    """
    none = np.zeros((0, 3), dtype=np.int64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    known: dict[bytes, int] = {}
    ids = np.fromiter(map(known.setdefault, itertools.chain.from_iterable(texts), itertools.count()), np.int64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    marked = np.zeros(len(texts), dtype=bool)
    for at, _ in _candidates(ids, starts, sizes):
        marked[np.searchsorted(starts, at, side="right") - 1] = True
    out = [none] * len(texts)
    chosen = np.flatnonzero(marked)
    if not chosen.size:
        return out
    # texts with candidates, each behind a separator, and one at the end
    line = []
    for i, t in enumerate(chosen):
        line += [np.array([-1 - i]), ids[starts[t] : starts[t] + sizes[t]]]
    line = np.concatenate([*line, np.array([-1 - len(chosen)])])
    begin = np.cumsum(sizes[chosen] + 1) - sizes[chosen]
    grammar = Grammar(line)
    found = [none]
    for at, q in _candidates(line, begin, sizes[chosen]):
        ahead = grammar.extension(at, at + q, 1)
        behind = grammar.extension(at - 1, at + q - 1, -1)
        length = behind + q + ahead
        fits = length >= np.maximum(LEAST, POWER * q)
        found.append(np.unique(np.stack((at - behind, length, q), axis=1)[fits], axis=0))
    rows = np.unique(np.concatenate(found), axis=0)
    # of periods of one stretch the smallest is its period, the others are multiples
    first = np.ones(len(rows), dtype=bool)
    first[1:] = np.any(rows[1:, :2] != rows[:-1, :2], axis=1)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    owner = np.searchsorted(begin, rows[:, 0], side="right") - 1
    cuts = np.searchsorted(owner, np.arange(len(chosen) + 1))
    for i, t in enumerate(chosen):
        mine = rows[cuts[i] : cuts[i + 1]].copy()
        mine[:, 0] -= begin[i]
        out[t] = mine
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words without those that any run contains after its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def _groups(column: pa.Array) -> Iterator[list[list[bytes]]]:
    """Words of the texts in groups of about ``GROUP`` words; texts are never cut."""
    group, size = [], 0
    for text in column.cast(pa.large_binary()):
        words = (text.as_py() or b"").split()  # bytes split at space and U+0009 to U+000D only
        if group and size + len(words) > GROUP:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        done = 0
        for group in _groups(batch.column("text")):
            runs = find_runs(group)
            texts = [b" ".join(collapse(w, r)).decode() for w, r in zip(group, runs, strict=True)]
            listed = [[{"start": s, "length": n, "period": q} for s, n, q in r.tolist()] for r in runs]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(done, len(group)),
                    pa.array([len(w) for w in group], pa.int64()),
                    pa.array(listed, kind),
                    pa.array(texts, pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )
            done += len(group)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """All runs of words in each whole text: ``doc_id, n_words, runs, collapsed``.

    ``runs`` lists (start, length, period) by start, then period; ``collapsed`` holds the words that no run contains after its
    first period, joined by single spaces.  Words are cut at space and U+0009 to U+000D and compared as they are.
    Each text is one task's work and no row moves.  Null and empty texts have no words and no runs; repeated rows are
    answered each; a null id stays null; extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scan, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def with_periods(docs: DataFrame) -> DataFrame:
    """Documents whose ids' crc32 ends in 0 with a periodic tail: from word a on, the next p words repeat to the end.

    With h the crc32, g = h / 10 and n words, a = g % n and p = 1 + (n - a) / (3 + g % 8), in whole numbers.  Rows with a null id
    or without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("h", h)
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    rows = rows.withColumn("words", words).withColumn("n", F.size("words")).withColumn("g", F.expr("h DIV 10"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", F.expr("CAST(1 + (n - a) DIV (3 + g % 8) AS INT)"))
    tail = "slice(flatten(array_repeat(slice(words, a + 1, p), CAST((n - a) DIV p + 1 AS INT))), 1, n - a)"
    text = F.expr(f"CASE WHEN a IS NOT NULL THEN array_join(concat(slice(words, 1, a), {tail}), ' ') ELSE text END")
    return rows.select("doc_id", text.alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row per document: number of runs, the run of greatest exact exponent, and hashes of all runs and of the kept words."""
    rows = found.withColumn(
        "top",
        F.expr(
            "aggregate(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>), (t, r) -> "
            "CASE WHEN t IS NULL OR r.length * t.period > t.length * r.period THEN r ELSE t END)"
        ),
    )
    listed = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.expr("1000 * top.length DIV top.period").alias("exponent_milli"),
        F.sha2(F.expr(listed), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
