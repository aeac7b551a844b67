"""Language identification by nearest centroids of TF-IDF character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import held_out, stored

DIMENSIONS = 4096  # hashed n-grams
ORDERS = (1, 2, 3)
CENTROIDS = 4  # clusters of one language
SAMPLE = 1600  # texts the centroids are fitted on at most, shared evenly by the languages
UNDETERMINED = "und"
SHORT = 50  # letters over which the allowance for short texts fades
_CHARS = 1 << 18  # characters described at once


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and the lower case of each (itself where that is no single letter)."""
    letter, lower = np.zeros(sys.maxunicode + 1, dtype=bool), np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            if len(low := c.lower()) == 1:
                lower[i] = ord(low)
    return letter, lower


_TABLES: list[np.ndarray] = []


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of the texts, anything but letters as 0, with the text of each; and letters per text."""
    if not _TABLES:
        _TABLES.extend(_tables())
    letter, lower = _TABLES
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    is_letter = letter[codes]
    codes = np.where(is_letter, lower[codes], 0)
    return codes, owner, np.bincount(owner, is_letter, len(texts))


def counts(texts: list[str], dimensions: int = DIMENSIONS, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams (texts x dimensions) and letters per text.

    An n-gram runs over letters and at most the gaps beside a word; longer gaps count as one.
    """
    codes, owner, letters = _letters(texts)
    keep = np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])))
    codes, owner = codes[keep].astype(np.uint64), owner[keep]
    total = np.zeros(len(texts) * dimensions)
    for n in orders:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
        some = np.zeros(len(h), dtype=bool)
        for j in range(n):
            part = codes[j : j + len(h)]
            h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            some |= part != 0
        some &= owner[: len(h)] == owner[n - 1 :]
        if n > 2:  # a gap inside joins two words
            for j in range(1, n - 1):
                some &= codes[j : j + len(h)] != 0
        at = owner[: len(h)][some] * dimensions + (h[some] % np.uint64(dimensions)).astype(np.int64)
        total += np.bincount(at, minlength=len(total))
    return total.reshape(len(texts), dimensions), letters


def _runs(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts of a column (null: empty) in runs of about ``_CHARS`` characters; no text is cut."""
    run, start, size = [], 0, 0
    for i, text in enumerate(column):
        text = text.as_py() or ""
        if run and (size + len(text) > _CHARS or len(run) == 256):
            yield start, run
            run, start, size = [], i, 0
        run.append(text)
        size += len(text)
    if run:
        yield start, run


@dataclass
class Model:
    """Unit centroids with their language, IDF weights and the distance beyond which a language is rejected."""

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    radius: np.ndarray

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tf, letters = counts(texts)
        v = np.log1p(tf) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12), letters

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language (-1: undetermined), score and whether the text is too far from its language."""
        v, letters = self.vectors(texts)
        if not self.languages:
            none = np.full(len(texts), -1)
            return none, np.zeros(len(texts)), none < 0
        close = v @ self.centroids.T
        best = np.stack([close[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1)
        pick = best.argmax(axis=1)
        top = best[np.arange(len(texts)), pick]
        odds = np.exp(20 * (best - top[:, None]))  # the nearest against the other languages
        score = np.where(letters > 0, 1 / odds.sum(axis=1), 0.0)
        reach = self.radius[pick]
        reach = reach + np.maximum(1 - reach, 0) * np.exp(-letters / SHORT)  # few letters are far from any centroid
        far = (1 - top > reach) | (letters == 0)
        return np.where(letters > 0, pick, -1), score, far


def spherical_kmeans(v: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Unit centroids of unit vectors; seeded by the vectors farthest from those chosen before."""
    k = min(k, len(v))
    centre = v.mean(axis=0)
    chosen = [int((v @ centre).argmax())]
    while len(chosen) < k:
        chosen.append(int((v @ v[chosen].T).max(axis=1).argmin()))
    c = v[chosen]
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        new = np.stack([v[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(k)])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c):
            break
        c = new
    return c


def train(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, slack: float = 0.1) -> Model:
    """Learn from ``docs(doc_id, text, lang)``; rows without language or letters teach nothing.

    Document frequencies come from all texts.  Centroids are fitted on a bounded sample: of each language the ids
    whose hash comes first, ``sample`` in all but at least one a language; of an id's texts in that language the least.
    A language rejects texts farther from its nearest centroid than the farthest of its sample and ``slack`` more;
    short texts are allowed more.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    docs = docs.where("text IS NOT NULL AND lang IS NOT NULL AND lang <> 'und'")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            for _, texts in _runs(batch.column("text")):
                df += (counts(texts)[0] > 0).sum(axis=0)
                n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.concatenate(([n], df)))], ["i", "df"])

    tally = docs.select("text").mapInArrow(frequencies, "i long, df long").groupBy("i").agg(F.sum("df").alias("df"))
    tally = dict(tally.collect())  # one row per dimension
    if not tally.get(-1):
        return Model([], np.zeros(0, int), np.zeros((0, DIMENSIONS)), np.zeros(DIMENSIONS), np.zeros(0))
    df = np.array([tally[i] for i in range(DIMENSIONS)])
    idf = np.log((1 + tally[-1]) / (1 + df)) + 1

    named = docs.where("doc_id IS NOT NULL")
    n_languages = named.agg(F.count_distinct("lang")).first()[0]
    if not n_languages:
        return Model([], np.zeros(0, int), np.zeros((0, DIMENSIONS)), idf, np.zeros(0))
    share = max(1, sample // n_languages)
    # all languages in one scan; a hot language is ranked in eight parts, whose first ``share`` ids are ranked together
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = named.select("lang", "doc_id").distinct().withColumn("_part", F.pmod(F.hash("doc_id"), F.lit(8)))
    for keys in (["lang", "_part"], ["lang"]):
        picked = picked.withColumn("_turn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_turn") <= share)
    picked = picked.select("lang", "doc_id")
    if n_languages <= sample:
        picked = F.broadcast(picked)  # ``sample`` rows at most; more languages are joined by shuffle
    # one text of each id, the least, so repeated ids do not grow the sample
    texts = named.join(picked, ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    texts = stored(texts, "sample").select("lang", "text")
    model = Model([], np.zeros(0, int), np.zeros((0, DIMENSIONS)), idf, np.zeros(0))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, some in _runs(batch.column("text")):
                v, letters = model.vectors(some)
                ok = np.flatnonzero(letters > 0)
                raw = pa.array([x.astype(np.float32).tobytes() for x in v[ok]], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(start, len(some)).take(pa.array(ok)), raw], ["lang", "v"])

    rows = texts.mapInArrow(vectors, "lang string, v binary").collect()  # ``share`` vectors a language at most
    by: dict[str, list[bytes]] = {}
    for r in rows:
        by.setdefault(r.lang, []).append(bytes(r.v))
    languages, owner, found, radius = [], [], [], []
    for name in sorted(by):
        v = np.array([np.frombuffer(x, dtype=np.float32) for x in sorted(by[name])], dtype=np.float64)
        c = spherical_kmeans(v, centroids)
        radius.append((1 - (v @ c.T).max(axis=1)).max() + slack)
        owner += [len(languages)] * len(c)
        languages.append(name)
        found.append(c)
    centres = np.concatenate(found) if found else np.zeros((0, DIMENSIONS))
    return Model(languages, np.array(owner, dtype=int), centres, idf, np.array(radius))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*model.languages, UNDETERMINED])
        for batch in batches:
            out = [model.predict(texts) for _, texts in _runs(batch.column("text"))]
            pick, score, far = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0), np.zeros(0, bool))
            named = names.take(pa.array(np.where(pick < 0, len(model.languages), pick)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), named, pa.array(score), pa.array(far)], ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = [model.predict(texts)[2] for _, texts in _runs(batch.column("text"))]
            if far:
                yield batch.filter(pa.array(~np.concatenate(far)))

    return docs.mapInArrow(run, docs.schema)


def languages(docs: DataFrame, **options) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod 4 is not 2 and predict all: ``doc_id, held_out, lang_pred, score, rejected``.

    A null text, or one without letters, is ``und`` with score 0 and rejected; so is any if nothing could be learned.
    The score weighs the nearest language against the others; ``rejected`` marks texts too far from their
    nearest language.  Repeated rows are predicted each, extra columns are ignored, an empty table gives an empty result.
    """
    model = train(docs.where(~held_out("doc_id", 4, 2)), **options)
    out = predict(docs, model).withColumn("held_out", held_out("doc_id", 4, 2))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
