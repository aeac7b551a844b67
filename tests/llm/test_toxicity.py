"""Positive-unlabelled learning: features, the risk estimator, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
import pytest

from tidemark.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, score string, toxic string"


def corpus(n=700, seed=2):
    rng = random.Random(seed)
    words = [a + b for a in "ba ce di fo gu ha".split() for b in "n l rk st zzo mp ti".split()]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) + rng.choice(words) for _ in range(rng.randrange(20, 90))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randrange(2, 4) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["nasty", "vile,", "horrid" + rng.choice(words)]))
        docs.append((i, " ".join(text), "en", "clash", "clash"))
        if rng.random() < 0.6:
            labels.append((i, 1, int(toxic)))
    return docs, labels, {i for i, t, *_ in docs if "nasty" in t or "vile" in t or "horrid" in t}


def test_held_out_accuracy_and_rows(spark):
    docs, labels, truth = corpus()
    docs += [(900, None, None, "", ""), (901, "", None, "", ""), (None, "nasty vile", None, "", ""), (5, docs[5][1], "en", "", "")]
    frame = spark.createDataFrame(docs, SCHEMA)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(frame.repartition(3), marks).collect()
    assert len(rows) == len(docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 700]
    yes, no = [[r.score for r in held if (r.doc_id in truth) == x] for x in (True, False)]
    assert np.mean([a > b for a in yes for b in no]) > 0.95  # area under the curve
    assert np.mean([r.predicted for r in held if r.doc_id in truth]) > 0.85
    # labels of the held-out fold are never looked at
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    again = toxicity.toxicity(frame.repartition(7), spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")).collect()
    assert sorted(((r.doc_id or -1, round(r.score, 9)) for r in again)) == sorted(((r.doc_id or -1, round(r.score, 9)) for r in rows))


def test_without_labels_or_rows(spark):
    docs, labels, _ = corpus(20)
    frame = spark.createDataFrame(docs, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 0.01 and r.predicted == 0 for r in toxicity.toxicity(frame, none).collect())
    assert toxicity.toxicity(frame.limit(0), spark.createDataFrame(labels, "doc_id long, q int, toxic int")).collect() == []


def test_features_are_words_and_starts():
    def of(*texts):
        owner, found = toxicity.unique_features([t.encode() for t in texts])
        return [set(found[owner == i].tolist()) for i in range(len(texts))]

    a, b, c, d, e = of("Stupid!", "stupid", "stupider x", "", "stup")
    assert a == b and len(a) == 1 + 2  # the word, starts of 4 and 5 bytes
    assert len(a & c) == 2 and not d
    assert not e & a  # a whole word is no start
    long = of("x" * 300, "x" * 301)
    assert len(long[0]) == 8 and len(long[0] & long[1]) == 7
    only = np.sort(np.array(sorted(a), dtype=np.uint64))
    assert [len(x) for x in (toxicity.unique_features([b"Stupid, stupid"], only)[1],)] == [3]


def test_risk_is_corrected():
    """With a planted feature of known rates the score comes near the true posterior."""
    rng = np.random.default_rng(0)
    prior, inside, outside = 0.2, 0.7, 0.05
    positive = [np.flatnonzero([rng.random() < inside]) for _ in range(3000)]
    unlabelled = [np.flatnonzero([rng.random() < (inside if rng.random() < prior else outside)]) for _ in range(9000)]
    w, b = toxicity.nnpu(positive, unlabelled, 1, prior, decay=0, steps=3000, rate=0.02)
    want = prior * inside / (prior * inside + (1 - prior) * outside)
    assert 1 / (1 + np.exp(-(w[0] + b))) == pytest.approx(want, abs=0.08)
    want = prior * (1 - inside) / (prior * (1 - inside) + (1 - prior) * (1 - outside))
    assert 1 / (1 + np.exp(-b)) == pytest.approx(want, abs=0.05)


def test_repeated_ids_do_not_grow_the_sample(spark):
    docs, labels, _ = corpus(200)
    schema = "doc_id long, text string"
    once = [d[:2] for d in docs]
    again = once + [(i, t + " zzz") for i, t in once[:50]] * 20
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one = toxicity.train(spark.createDataFrame(once, schema), marks)
    two = toxicity.train(spark.createDataFrame(again, schema).repartition(5), marks)
    assert one.known.tolist() == two.known.tolist() and np.allclose(one.weights, two.weights) and one.prior == two.prior
