"""The pipeline's stages against plain code on the smallest test tables."""

import re

import pytest

import corpus_pipeline
from tests.llm.test_simhash import brute_components, brute_print
from tidemark.llm import langid, mixing, secrets
from tidemark.llm.common import held_out, stored

SF = "/root/testdata/sf0.001"
ODD = [
    (9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, " 12 ### ", "en", None, 8), (None, "The and of thing to the ers", "en", "src0", 27),
    (9005, "And the thing of ers " * 9 + "password=0a1b2c3d4e5f607182 and the card 4111111111111111 to be", "en", "src4", 1),
    (9004, "the and ing " * 20000, "en", "src2", None), (5000001, "x", None, "src3", 1),
]


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(ODD, docs.schema)
    docs = stored(docs.union(odd).union(docs.where("doc_id < 3")), "in")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], SF), name))
    return tables


def test_stages(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secrets", "mixing", "packing"]
    assert all(t.columns == kept[0].columns for t in kept[:-1])
    assert 150 < kept[1].count() and 100 < kept[2].count()


def test_language_stage(kept):
    model = langid.train(kept[0].where(~held_out("doc_id", 4, 2)))
    rows = kept[0].collect()
    far = model.predict([r.text or "" for r in rows])[2]
    assert sorted(map(str, kept[1].collect())) == sorted(str(r) for r, f in zip(rows, far) if not f)
    gone = [r for r, f in zip(rows, far) if f]
    assert {9001, 9002, 9003} <= {r.doc_id for r in gone} and len(gone) < 12


def test_near_duplicate_stage(kept):
    rows = [r for r in kept[1].collect() if r.doc_id is not None]
    by = {r.doc_id: r.text for r in rows}
    component = brute_components(list(by), [brute_print(t) for t in by.values()], 4)
    got = kept[2].collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(i for i, c in component.items() if i == c)
    assert sum(r.doc_id is None for r in got) == 1 and all(by.get(r.doc_id, r.text) == r.text for r in got)


def test_texts_of_one_id_are_told_apart(spark):
    """An id with unrelated texts keeps both; of near texts under one id, and of copies under others, one stays."""
    base = " ".join(f"word{i}" for i in range(400))
    other = " ".join(f"thing{i}" for i in range(400))
    third = " ".join(f"item{i}" for i in range(400))
    rows = [
        (1, base), (3, base), (3, other), (4, third), (4, third + " more"), (5, other), (6, " ".join(f"a{i}" for i in range(300))),
        (6, " ".join(f"b{i}" for i in range(300))), (7, third), (8, None), (9, ""), (8, None), (None, base), (3, other),
    ]
    docs = stored(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), "x")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.dedup_stage(spark, docs, SF).collect()), key=str)
    near = {r.text for r in docs.collect() if r.doc_id == 4}
    fours = [t for i, t in got if i == 4]
    assert len(fours) == 1 and fours[0] in near
    assert [g for g in got if g[0] != 4] == sorted([(None, base), (1, base), (3, other), (6, rows[6][1]), (6, rows[7][1]), (8, None)], key=str)


def test_secrets_stage(kept):
    model = secrets.train(kept[2])
    before, after = ({r.doc_id: r for r in t.collect()} for t in kept[2:4])
    assert before.keys() == after.keys()
    masked = 0
    for i, r in before.items():
        text = r.text
        for a, b, s in reversed(model.scan(text)):
            if s >= model.threshold:
                text = text[:a] + secrets.MASK + text[b:]
        masked += text != r.text
        assert after[i].text == text and after[i].n_chars == len(text)
        assert not re.search(r"AKIA[A-Z0-9]{16}|password=[0-9a-f]{18}", after[i].text)
    assert masked


def test_mixing_stage(kept):
    before, after = kept[3].collect(), kept[4].collect()
    sources = sorted({r.source for r in before}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(words(r.text)) for r in before if r.source == s) for s in sources]
    want = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))])
    texts = {r.doc_id: words(r.text) for r in before}
    for s, target in zip(sources, want):
        assert sum(len(words(r.text)) for r in after if r.source == s) == int(target + 1e-6)
    for r in after:
        assert texts[r.doc_id][: len(words(r.text))] == words(r.text)
    assert max(sum(r.doc_id == i for r in after) for i in texts) <= 3


def test_packing_stage(kept):
    mixed, packed = kept[4].collect(), kept[5].collect()
    total = {}
    for r in mixed:
        total[r.doc_id] = total.get(r.doc_id, 0) + len(words(r.text))
    got, used = {}, {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r["size"]
        used.setdefault((r.sequence_id, r.sequence_length), []).append((r.offset, r["size"]))
    assert got == total
    for (_, length), spans in used.items():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at <= length


def test_run_and_empty(spark, kept, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 100
    empty = kept[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
