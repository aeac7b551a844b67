"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, stored
from tidemark.llm.words import _LOWER, _ODD, _TURN, _VALUES, mixed, pieces

POSITIVES = 3000  # confirmed toxic texts the model is fitted on at most
UNLABELLED = 9000  # unlabelled texts it is fitted on at most
FEATURES = 2048  # words and word starts it may weigh
STARTS = range(4, 11)  # bytes of a word's start that count as a feature of longer words

_CUT = np.zeros(256, dtype=bool)  # everything in ASCII but letters and digits separates words
_CUT[:128] = True
_CUT[48:58] = _CUT[65:91] = _CUT[97:123] = False


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of proper word starts in ``texts``, each with the index of its text; repeats included."""
    buffer = _LOWER[np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)]
    edge = np.diff(np.concatenate(([True], _CUT[buffer], [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    place = np.arange(len(buffer))
    word = np.searchsorted(starts, place, side="right") - 1
    place -= starts[np.maximum(word, 0)]
    values = _VALUES[((place & (_TURN - 1)) << 8) | buffer] * (((place // _TURN).astype(np.uint64) << np.uint64(1)) | np.uint64(1))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
    found, owners = [mixed(sums[ends] - sums[starts])], [owner]
    for k in STARTS:
        longer = ends - starts > k
        found.append(mixed(sums[starts[longer] + k] - sums[starts[longer]] + np.uint64(k) + _ODD))
        owners.append(owner[longer])
    return np.concatenate(found), np.concatenate(owners)


def unique_features(texts: list[bytes], only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, sorted by text; with ``only`` (sorted) as indices into it."""
    found, owner = features(texts)
    if only is not None:
        gate = np.zeros(1 << 20, dtype=bool)
        gate[(only >> np.uint64(44)).astype(np.int64)] = True
        near = np.flatnonzero(gate[(found >> np.uint64(44)).astype(np.int64)])
        found, owner = found[near], owner[near]
        at = np.minimum(np.searchsorted(only, found), max(len(only) - 1, 0))
        same = only[at] == found if len(only) else np.zeros(len(found), dtype=bool)
        key = np.unique(owner[same] * (len(only) + 1) + at[same])
        return key // (len(only) + 1), key % (len(only) + 1)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.concatenate(([True], (np.diff(found) != 0) | (np.diff(owner) != 0)))[: len(found)]
    return owner[new], found[new]


@dataclass
class Model:
    """Weights of sorted feature hashes; ``prior`` is the share of toxic texts it was corrected by."""

    known: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        owner, at = unique_features(texts, self.known)
        logit = self.bias + np.bincount(owner, self.weights[at], len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], n: int, prior: float, seed: int = 7, steps: int = 1000,
         rate: float = 0.05, decay: float = 1e-3, batch: int = 512) -> tuple[np.ndarray, float]:
    """Linear classifier over ``n`` binary features (each text: its feature indices), logistic loss.

    Minimises ``prior * R(p, +) + max(0, R(u, -) - prior * R(p, -))`` with Adam; where the part in the maximum turns
    negative, its gradient is followed upwards, so the model does not profit from memorising the positives.
    """
    rng = np.random.default_rng(seed)
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[n] = np.log(prior / (1 - prior))

    def rows(of: list[np.ndarray]):
        pick = rng.integers(0, len(of), min(batch, len(of)))
        return np.repeat(np.arange(len(pick)), [len(of[i]) for i in pick]), np.concatenate([of[i] for i in pick]), len(pick)

    def back(row, at, by):  # gradient of a mean over rows
        return np.concatenate((np.bincount(at, by[row], n), [by.sum()])) / len(by)

    for step in range(1, steps + 1):
        (pr, pa_, pn), (ur, ua, un) = rows(positive), rows(unlabelled)
        fp = w[n] + np.bincount(pr, w[pa_], pn)
        fu = w[n] + np.bincount(ur, w[ua], un)
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        low = back(ur, ua, su) - prior * back(pr, pa_, sp)
        g = prior * back(pr, pa_, sp - 1) + low if negative >= 0 else -low
        g[:n] += decay * w[:n]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:n], float(w[n])


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, size: int = FEATURES) -> Model:
    """Fit on ``docs(doc_id, text)``: toxic ones in ``labels(doc_id, toxic)`` against texts taken without their labels.

    The class prior is the share of toxic rows among all labelled documents given.  The texts fitted on are those
    whose hashed id comes first, ``positives`` and ``unlabelled`` at most, and of an id's texts the least.  A feature is weighed if it is in 3 or more toxic texts (and 1 in 75), half
    as often again as in unlabelled ones; the ``size`` clearest are taken.  Weight decay falls with the number of toxic texts.  Without a toxic row the model has no feature
    and scores everything 0.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("turn", F.xxhash64("doc_id"))
    marked = ids.join(marks, "doc_id", "left").select("doc_id", "turn", (F.col("toxic") == 1).alias("toxic"))
    marked = stored(marked, "marks")
    counts = marked.agg(F.count("toxic").alias("n"), F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0)).alias("t")).first()
    if not counts.t:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -50.0, 0.0)
    prior = min(max(counts.t / counts.n, 1e-4), 0.9)
    chosen = marked.where("toxic").orderBy("turn", "doc_id").limit(positives).select("doc_id", F.lit(True).alias("p")).union(
        marked.orderBy("turn", "doc_id").limit(unlabelled).select("doc_id", F.lit(False))
    )
    # at most positives + unlabelled ids, by the limits above
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # one text of each id, the least, so repeated ids do not grow the sample
    picked = stored(picked.groupBy("doc_id", "p").agg(F.min("text").alias("text")), "sample").select("p", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("p").to_numpy(zero_copy_only=False).astype(bool)
            for start, texts in pieces(batch.column("text")):
                owner, found = unique_features(texts)
                toxic = marks[start + owner]
                names, back = np.unique(found, return_inverse=True)
                np_ = np.bincount(back, toxic, len(names)).astype(np.int64)
                nu = np.bincount(back, ~toxic, len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np_), pa.array(nu)], ["h", "np", "nu"])

    totals = picked.agg(F.sum(F.col("p").cast("int")).alias("p"), F.sum((~F.col("p")).cast("int")).alias("u")).first()
    tally = picked.mapInArrow(count, "h long, np long, nu long").groupBy("h").agg(F.sum("np").alias("np"), F.sum("nu").alias("nu"))
    p, u = F.col("np") / totals.p, (F.col("nu") + 1) / (totals.u + 2)
    tally = tally.where((F.col("np") >= max(3, totals.p // 75)) & (p > 1.5 * u)).withColumn("z", (p - u) / F.sqrt(u * (1 - u) / totals.p))
    best = tally.orderBy(F.desc("z"), "h").limit(size).select("h").collect()  # size rows at most
    known = np.sort(np.array([r.h for r in best], dtype=np.int64).view(np.uint64))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in pieces(batch.column("text")):
                owner, at = unique_features(texts, known)
                cut = np.searchsorted(owner, np.arange(1, len(texts)))
                lists = pa.array([x.astype(np.int32) for x in np.split(at, cut)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("p").slice(start, len(texts)), lists], ["p", "at"])

    rows = picked.mapInArrow(vectors, "p boolean, at array<int>").collect()  # the bounded sample's feature indices
    sets = {True: [], False: []}
    for r in rows:
        sets[r.p].append(np.array(r.at, dtype=np.int64))
    for s in sets.values():  # an order of its own, so that reruns agree
        s.sort(key=lambda x: (len(x), x.tobytes()))
    return Model(known, *nnpu(sets[True], sets[False], len(known), prior, decay=1e-3 * (1 + 200 / totals.p)), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every whole text; null and empty texts get the score of a text without features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(texts) for _, texts in pieces(batch.column("text"))]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Train on the rows whose crc32(doc_id) mod 4 is not 2 and score all: ``doc_id, held_out, score, predicted``.

    Labels are looked up by id for training only; a prediction sees the text alone.  Repeated rows are scored each,
    rows without an id are scored and not trained on, extra columns are ignored, an empty table gives an empty result.
    """
    seen = ~held_out("doc_id", 4, 2)
    model = train(docs.where(seen), labels.where(seen), **options)
    out = score(docs, model).withColumn("held_out", held_out("doc_id", 4, 2))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
