"""Quality rules: counts against plain Python, sketches, odd rows."""

import random
import re

from pyspark.sql import functions as F

from tidemark.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, level string"


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
    )


def test_counts_and_verdicts(spark):
    rng = random.Random(4)
    texts = []
    for i in range(120):
        words = [rng.choice(["ab", "c", "dé#", "xyzzy", "|", "ü n", "A"]) + (str(rng.randrange(30)) if i % 3 else "") for _ in range(rng.randrange(0, 150))]
        texts.append("".join(w + rng.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c"]) for w in words))
    texts += ["", None, " \n ", "one two", "a b c a b c", "l\nl\nl\n\n", "z " * 20000, "  \x85 x"]
    rows = [(i, t, rng.choice(["en", None, "de"]), rng.choice(["s", None, "t"]), "x", "y") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, SCHEMA).repartition(3), least=10).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(texts):
        r, want = got[i], brute(t) if t is None or len(t) < 9999 else (20000, 20000, 0, 0, 20000)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.quality(spark.createDataFrame(rows, SCHEMA).limit(0)).collect() == []


def test_buckets_are_close_and_ordered(spark):
    v = spark.range(0, 200000).select("id", F.expr(quality.bucket("id")).alias("b"))
    rows = v.select("id", "b", F.expr(quality.bucket_floor("b")).alias("low")).orderBy("id").collect()
    assert all(r.low <= r.id < r.low * 65 / 64 + 1 for r in rows)
    assert all(a.b <= b.b for a, b in zip(rows, rows[1:]))


def test_groups_fall_back_to_merged_sketches(spark):
    rows = [("en", "a", "m", i % 5, 1) for i in range(30)] + [("en", "b", "m", 9, 1), ("fr", "a", "m", 4, 1)]
    sketch = spark.createDataFrame(rows, "lang_key string, source_key string, metric string, bucket long, n long")
    rule = (quality.Rule("m", "x", 900, 3),)
    got = {(r.lang_key, r.source_key): (r.level, r.m_high) for r in quality.thresholds(sketch, rule, 10).collect()}
    assert got == {("en", "a"): (2, 4 + 3 * 2), ("en", "b"): (1, 4 + 3 * 2), ("fr", "a"): (0, 4 + 3 * 2)}


def test_outliers_go_and_clean_documents_stay(spark):
    clean = [" ".join(f"word{(i * 31 + j * 7) % 997}" for j in range(80)) for i in range(200)]
    junk = [" ".join(f"w{j}###$$$" for j in range(80)), " ".join("x" * 40 + str(j) for j in range(80))]
    rows = [(i, t, "en", "s", "", "") for i, t in enumerate(clean + junk)]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] for i in range(200)) and not got[200] and not got[201]


def test_fences_follow_the_group(spark):
    """A rate that is common in one source is junk in another, and no rate is a constant."""
    plain = [" ".join(f"word{(i * 31 + j * 7) % 997}" for j in range(80)) for i in range(150)]
    marked = [" ".join(f"word{(i * 31 + j * 7) % 997}" + "#" * (j % (2 + i % 3) == 0) for j in range(80)) for i in range(150)]
    rows = [(i, t, "en", "plain", "", "") for i, t in enumerate(plain)] + [(200 + i, t, "en", "marked", "", "") for i, t in enumerate(marked)]
    rows += [(500, marked[0], "en", "plain", "", ""), (501, marked[1].replace("#", "#" * 40), "en", "marked", "", "")]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [i for i in got if not got[i]] in ([500, 501], [501, 500])
