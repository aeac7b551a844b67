"""Nearest-centroid language identification."""

import random
import zlib

import numpy as np

from tidemark.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string, lang_pred string"
SYLLABLES = {"aa": "the and ing ion er th".split(), "bb": "que é au eux ré ment".split(), "cc": "ция ов ск при ств го".split()}


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 120))]
        docs.append((i, " ".join(words).capitalize(), lang, "clash", "clash"))
    return docs


def test_held_out_accuracy_rejection_and_odd_rows(spark):
    docs = corpus()
    odd = [(1000, None), (1001, ""), (1002, " 12 ### !"), (1003, "漢字仮名交じり文" * 30), (1004, "The " * 30000), (None, "the and"), (7, docs[7][1])]
    rows = docs + [(i, t, None, "", "") for i, t in odd]
    got = langid.languages(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.lang_pred in ("und", *SYLLABLES)
    truth = {i: x for i, _, x, *_ in docs}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert not any(r.rejected for r in got if r.doc_id in truth)
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True) for i in (1000, 1001, 1002))
    assert by[1003].rejected and by[1004].lang_pred == "aa"


def test_prediction_sees_only_texts(spark):
    docs = corpus(120)
    def run(rows):
        return sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.languages(spark.createDataFrame(rows, SCHEMA)).collect())
    hidden = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else x, "", "") for i, t, x, *_ in docs]
    assert run(docs) == run(hidden)


def test_nothing_learned_and_empty(spark):
    rows = [(i, "text", None, "", "") for i in range(5)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert {(r.lang_pred, r.rejected) for r in langid.languages(frame).collect()} == {("und", True)}
    assert langid.languages(frame.limit(0)).collect() == []


def test_counts_match_plain_code():
    texts = ["Ab, c!", "", "ÀB", "a  b1c"]
    found, letters = langid.counts(texts, 1 << 16)
    assert letters.tolist() == [3, 0, 2, 3]
    # uni-grams with gaps as one, bi-grams, tri-grams without inner gap
    assert found.sum(axis=1).astype(int).tolist()[1] == 0
    again, _ = langid.counts(["ab c"], 1 << 16)
    assert (again[0] > 0).sum() <= (found[0] > 0).sum()
    both, _ = langid.counts(["Ab, c!", "ab  c "], 1 << 16)
    assert np.array_equal(both[0], both[1])


def test_kmeans_separates():
    rng = np.random.default_rng(0)
    v = np.concatenate([np.eye(5)[i] + 0.05 * rng.random((20, 5)) for i in range(3)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    c = langid.spherical_kmeans(v, 3)
    assert sorted(c.argmax(axis=1).tolist()) == [0, 1, 2]


def test_one_text_of_an_id_and_every_language(spark):
    """Repeated ids add one text each, a language beyond the sample's size still has a centroid, one group limit finds all."""
    docs = [d[:3] for d in corpus(90)]
    frame = spark.createDataFrame(docs + [(docs[0][0], docs[0][1] + "z", docs[0][2])] * 500, "doc_id long, text string, lang string")
    once = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.train(frame.repartition(5), sample=3000)
    assert model.languages == ["aa", "bb", "cc"]
    few = langid.train(once, sample=2, centroids=1)
    assert few.languages == ["aa", "bb", "cc"] and len(few.owner) == 3
    assert langid.train(once.where("doc_id IS NULL")).languages == []
