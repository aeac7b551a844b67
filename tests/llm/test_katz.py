"""Katz backoff against a plain model."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import katz

SCHEMA = "doc_id long, text string, score string, run string, held string"
K, LARGE = katz.CLEAR, katz.LARGE


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + ["</s>"]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


class Plain:
    def __init__(self, rows):
        train = [tokens(t) for i, t in rows if not held(i)]
        self.c = Counter(w for t in train for w in t)
        self.pairs = Counter(p for t in train for p in zip(["<s>", *t], t))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.star1, self.star2 = self.stars(self.c), self.stars(self.pairs)
        self.unknown = 1 - sum(map(self.star1, self.c.values())) / self.n if self.n else 1
        self.after = defaultdict(dict)
        for (a, b), n in self.pairs.items():
            self.after[a][b] = n
        self.total = {a: sum(x.values()) for a, x in self.after.items()}
        self.alpha = {
            a: (1 - sum(map(self.star2, x.values())) / self.total[a]) / (1 - sum(map(self.word, x))) for a, x in self.after.items()
        }

    def stars(self, counts):
        n = Counter(counts.values())
        star = katz.discounted(np.array([n[r] for r in range(1, K + 2)]))
        return lambda c: star[c - 1] if c <= K else c - LARGE

    def word(self, w):
        return self.star1(self.c[w]) / self.n if self.c[w] else self.unknown

    def p(self, w, a):
        if a not in self.after:
            return self.word(w)
        return self.star2(self.after[a][w]) / self.total[a] if w in self.after[a] else self.alpha[a] * self.word(w)

    def row(self, text):
        t = tokens(text)
        base = sum(math.log10((self.c[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in t)
        return len(t), sum(self.c[w] > 0 for w in t), self.n, base, sum(math.log10(self.p(w, a)) for a, w in zip(["<s>", *t], t))


def corpus(n=160, seed=1, vocabulary=400):
    rng = random.Random(seed)
    words = [f"{rng.choice(['A', 'b', 'é', 'zz'])}{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choices(words, weights, k=rng.randrange(0, 120)))) for i in range(n)]
    rows += [(900, None), (901, ""), (902, "b1 " * 40000), (None, "a0 a0 b1 unique"), (3, rows[3][1]), (20, rows[20][1]), (20, rows[20][1])]
    rows += [(903 + i, "x" * (60 + i) + " " + "y" * 300 + str(i % 3)) for i in range(40)]
    return rows


@pytest.mark.parametrize("options", [{}, {"hot": 30, "top": 5, "bucket": 700}, {"hot": 0, "top": 0, "bucket": 3000}])
def test_equals_plain_model(spark, options, monkeypatch):
    rows = corpus()
    plain = Plain(rows)
    frame = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    got = katz.scores(frame.repartition(3), **options).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        want = plain.row(texts[r.doc_id])
        assert r.held_out == held(r.doc_id)
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3], rel=1e-9)
        assert r.score == pytest.approx(want[4], rel=1e-6)


def test_plain_model_sums_to_one():
    """What the operator is held against is normalised at both levels, unknown words as one class."""
    plain = Plain(corpus())
    assert sum(map(plain.word, plain.c)) + plain.unknown == pytest.approx(1)
    for a in ["<s>", "b1", "a0", list(plain.after)[50], "never seen"]:
        assert sum(plain.p(w, a) for w in plain.c) + plain.p("not a word", a) == pytest.approx(1)


def test_nothing_to_learn_and_empty(spark):
    ids = [i for i in range(200) if held(i)]
    frame = spark.createDataFrame([(i, "a b", "", "", "") for i in ids], SCHEMA)
    for r in katz.scores(frame).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert katz.scores(frame.limit(0)).collect() == []


def test_discounts():
    good = katz.discounted(np.array([1000, 400, 200, 110, 70, 50]))
    assert all(r < good[r] < r + 1 for r in range(1, K)) or all(0 < g < r for r, g in enumerate(good, 1))
    assert all(0 < g < r for r, g in enumerate(katz.discounted(np.array([3, 0, 2, 0, 0, 1])), 1))
    assert all(0 < g < r for r, g in enumerate(katz.discounted(np.zeros(6)), 1))


@pytest.mark.parametrize("count", [3, 60_000, 70_000, 1 << 20])
def test_frequent_words_are_bounded_and_never_none(spark, count):
    """Many words of one high count: no more than the limit come to the driver, and the most frequent always do."""
    words = spark.range(5000).selectExpr("id * 7919 + 11 AS h", f"CAST({count} + IF(id < 10, 9, 0) AS BIGINT) AS c")
    uni = katz.unigrams(words, hot=1000, top=64)
    assert 64 <= len(uni.hot) <= 1064 and uni.top.sum() == 64
    assert {i * 7919 + 11 for i in range(10)} <= set(uni.hot[uni.top].tolist())
    assert (uni.total, uni.types) == (5000 * count + 90, 5000)
    assert (np.diff(uni.hot.astype(np.int64)) > 0).all()


def test_document_rows_are_spread_over_buckets(spark):
    """Runs of many tasks reach all buckets, whatever the number of buckets."""
    docs = spark.createDataFrame([(i, "a b c", False) for i in range(200)], "doc_id long, text string, held boolean").repartition(200)
    uni = katz.unigrams(katz.word_counts(docs))
    for buckets in (64, 128):
        rows = docs.mapInArrow(katz._packer(uni, buckets), katz._IN.format(kind="bigint")).where("place >= 0")
        assert rows.select("bucket").distinct().count() > buckets // 3
