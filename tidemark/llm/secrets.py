"""Secret scan: broad candidates, and a random forest that removes false positives."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

TRAINED_ON = 20000  # labelled findings the forest is fitted on at most
DICTIONARY = 4096  # frequent words of the corpus
TREES, DEPTH, BINS = 40, 8, 32
MASK = "[SECRET]"

#: Runs of key characters with a digit, and whatever follows an assignment.
_RUN = re.compile(r"(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*[0-9])[A-Za-z0-9_+/\-]{16,}={0,2}")
_ASSIGNED = re.compile(r"""[=:][ \t]{0,3}["']?([^\s"'<>=:,;(){}\[\]]{8,})""")
_KEYS = re.compile(r"passw|pwd|secret|token|api_?key|apikey|access|auth|bearer|credential|private", re.I)
_PLAIN = re.compile(r"\b(id|sha|md5|commit|hash|uuid|order|card|phone|isbn|page|ref|http|https|url|file|path)\b", re.I)
_SHAPES = re.compile(r"(AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}")
FEATURES = (
    "length", "transitions", "entropy", "digits", "upper", "hex", "vowels", "repeats", "dictionary", "path", "slashes",
    "quoted", "assigned", "secret_words", "plain_words", "shape",
)


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of possible secrets, left to right without overlap."""
    spans = {m.span() for m in _RUN.finditer(text)} | {m.span(1) for m in _ASSIGNED.finditer(text)}
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or start >= out[-1][1]:
            out.append((start, end))
    return out


def _classes(value: str) -> str:
    return "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "o" for c in value)


def _covered(value: str, words: frozenset[str]) -> float:
    """Share of the characters that dictionary words of three letters or more can cover, longest first."""
    low, i, n = value.lower(), 0, 0
    while i < len(low):
        for j in range(min(len(low), i + 16), i + 2, -1):
            if low[i:j] in words:
                n += j - i
                i = j
                break
        else:
            i += 1
    return n / max(len(low), 1)


def describe(text: str, start: int, end: int, words: frozenset[str]) -> list[float]:
    """Feature values of the whole span, in the order of ``FEATURES``."""
    value, size = text[start:end], end - start
    kinds = _classes(value)
    share = Counter(value)
    before, after = text[max(0, start - 48) : start], text[end : end + 24]
    near = " ".join(before.split()[-3:])
    left, right = before[-1:], after[:1]
    return [
        size,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(size - 1, 1),
        -sum(c / size * math.log2(c / size) for c in share.values()),
        kinds.count("d") / size,
        kinds.count("u") / size,
        sum(c in "0123456789abcdefABCDEF" for c in value) / size,
        sum(c in "aeiouAEIOU" for c in value) / size,
        sum(a == b for a, b in zip(value, value[1:])) / size,
        _covered(value, words),
        float(left in ("/", "\\", ".") or right in ("/", "\\", ".") and after[1:2].isalnum() or "://" in before[-12:]),
        value.count("/"),
        float(left in ("'", '"') or right in ("'", '"')),
        float(bool(re.search(r"""[=:][ \t]*["']?$""", before))),
        float(bool(_KEYS.search(near))),
        float(bool(_PLAIN.search(near)) or bool(_PLAIN.search(after.split(" ")[0] if after else ""))),
        float(bool(_SHAPES.fullmatch(value))),
    ]


def finding_label(f: list[float]) -> float:
    """Label of a clear finding: 1 a secret, 0 none, -1 not clear. Used where no reviewed findings are given."""
    v = dict(zip(FEATURES, f))
    if v["shape"]:
        return 1
    mixed = v["digits"] > 0.05 and v["digits"] < 0.95 and v["entropy"] > 2.8 and v["length"] >= 12
    if v["assigned"] and v["secret_words"] and mixed and v["dictionary"] < 0.5:
        return 1
    if v["digits"] > 0.99 or v["dictionary"] > 0.6 or v["digits"] == 0 and not v["secret_words"]:
        return 0
    if v["path"] or v["plain_words"] and not v["secret_words"]:
        return 0
    return -1


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), threshold, children and the leaf's share of secrets."""

    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    constant: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.constant)
        total = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH + 1):
                f = feature[at]
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at]
                at = np.where(f < 0, at, np.where(go, left[at], right[at]))
            total += value[at]
        return total / len(self.trees)


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5, least: int = 2) -> Forest:
    """Bootstrapped trees, Gini splits over the square root of the features at each node."""
    if not len(y) or y.min() == y.max():
        return Forest([], float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    tries = max(1, math.isqrt(x.shape[1]))
    out = []
    for _ in range(trees):
        nodes: list[list] = []

        def grow(rows: np.ndarray, level: int) -> int:
            here, p = len(nodes), y[rows].mean()
            nodes.append([-1, 0.0, 0, 0, p])
            if level == depth or len(rows) < 2 * least or p in (0.0, 1.0):
                return here
            best = (len(rows) * p * (1 - p) - 1e-12, -1, 0.0)
            order = rng.permutation(x.shape[1])
            for tried, j in enumerate(order):
                if tried >= tries and best[1] >= 0:
                    break
                side = np.searchsorted(cuts[j], x[rows, j])
                n = np.cumsum(np.bincount(side, minlength=len(cuts[j]) + 1))[:-1]
                s = np.cumsum(np.bincount(side, y[rows], len(cuts[j]) + 1))[:-1]
                m, t = len(rows) - n, y[rows].sum() - s
                ok = (n >= least) & (m >= least)
                if ok.any():
                    bad = np.where(ok, s - s * s / np.maximum(n, 1) + t - t * t / np.maximum(m, 1), np.inf)
                    if bad.min() < best[0]:
                        best = (bad.min(), j, cuts[j][bad.argmin()])
            if best[1] >= 0:
                go = x[rows, best[1]] <= best[2]
                nodes[here][:2] = best[1:]
                nodes[here][2] = grow(rows[go], level + 1)
                nodes[here][3] = grow(rows[~go], level + 1)
            return here

        grow(rng.integers(0, len(y), len(y)), 0)
        columns = list(zip(*nodes))
        out.append((np.array(columns[0]), np.array(columns[1], float), np.array(columns[2]), np.array(columns[3]), np.array(columns[4], float)))
    return Forest(out)


@dataclass
class Model:
    words: frozenset[str]
    forest: Forest
    threshold: float = 0.5

    def scan(self, text: str) -> list[tuple[int, int, float]]:
        """Candidates of one text with their scores."""
        spans = candidates(text)
        if not spans:
            return []
        x = np.array([describe(text, a, b, self.words) for a, b in spans])
        return [(a, b, s) for (a, b), s in zip(spans, self.forest.predict(x).tolist())]


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> frozenset[str]:
    """Frequent words of three letters or more over all whole texts.

    Tasks pass on all their words with their counts, so the list does not depend on how rows lie in partitions.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            plain = {w: n for w, n in tally.items() if w.isalpha()}
            return pa.RecordBatch.from_arrays([pa.array(list(plain), pa.string()), pa.array(list(plain.values()), pa.int64())], ["w", "n"])

        tally: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                tally.update(w for w in (text.as_py() or "").lower().split() if 3 <= len(w) <= 16)
                if len(tally) > 200_000:
                    yield out()
                    tally = Counter()
        yield out()

    words = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "w string, n long")
    words = words.where(r"w rlike '^\\p{L}+$'").groupBy("w").agg(F.sum("n").alias("n"))
    return frozenset(r.w for r in words.orderBy(F.desc("n"), "w").limit(size).collect())


def train(docs: DataFrame, findings: DataFrame | None = None, limit: int = TRAINED_ON) -> Model:
    """Fit on labelled findings: ``findings(features array<double>, label)``, or else the corpus' own clear candidates.

    Findings beyond ``limit`` are left out by the order of their hash; words are counted over all texts.
    """
    words = dictionary(docs)
    if findings is None:

        def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, labels = [], []
                for text in batch.column("text"):
                    text = text.as_py() or ""
                    for a, b in candidates(text):
                        f = describe(text, a, b, words)
                        if (y := finding_label(f)) >= 0:
                            rows.append([float(v) for v in f])
                            labels.append(float(y))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.float64())], ["features", "label"])

        text = docs.select(F.col("text").cast("string").alias("text"))
        findings = stored(text.mapInArrow(label, "features array<double>, label double"), "findings")
    findings = findings.where("features IS NOT NULL AND label IS NOT NULL")
    # equal findings (copies of a document) teach once
    rows = findings.select("features", F.col("label").cast("double").alias("label")).distinct()
    rows = rows.orderBy(F.xxhash64("features", "label"), "features", "label").limit(limit).collect()
    x = np.array([r.features for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    return Model(words, fit_forest(x, np.array([r.label for r in rows])))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """One row per candidate of the whole texts: ``doc_id, start, end, length, score, is_secret`` (offsets in characters)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("text")):
                for f in model.scan(text.as_py() or ""):
                    at.append(i)
                    found.append(f)
            a, b, s = (np.array(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 2 + (np.zeros(0),)
            ids = batch.column("doc_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(a), pa.array(b), pa.array(b - a), pa.array(s, pa.float64()), pa.array(s >= model.threshold, pa.bool_())],
                ["doc_id", "start", "end", "length", "score", "is_secret"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, start long, end long, length long, score double, is_secret boolean")


def redact(docs: DataFrame, model: Model, mask: str = MASK) -> DataFrame:
    """The same rows with every confirmed secret in ``text`` replaced by ``mask``; other columns pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, out = batch.schema.get_field_index("text"), []
            for text in batch.column(k):
                text = text.as_py()
                parts, last = [], 0
                for a, b, s in model.scan(text) if text else ():
                    if s >= model.threshold:
                        parts += [text[last:a], mask]
                        last = b
                out.append("".join([*parts, text[last:]]) if parts else text)
            columns = list(batch.columns)
            columns[k] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def secrets(docs: DataFrame, findings: DataFrame | None = None, limit: int = TRAINED_ON) -> DataFrame:
    """Train and scan: one row per candidate of ``docs(doc_id, text)``, with the forest's score and verdict.

    Null and empty texts have no candidates; rows without an id are scanned; repeated rows are reported each; extra columns
    are ignored; an empty table gives an empty result.  With labels of one kind only, every candidate gets that kind.
    """
    return scan(docs, train(docs, findings, limit))
