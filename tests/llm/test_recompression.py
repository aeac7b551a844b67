"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np

from tidemark.llm import recompression
from tidemark.llm.recompression import Grammar, find_runs


def brute(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            if length >= max(6, 4 * q):
                found.setdefault((s, length), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = planted((text or "").encode().split(), doc_id)
    runs = brute(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def sample(rng, kind):
    n = rng.randrange(0, 60)
    letters = "ab" if kind == 0 else "abcdefghij"
    words = [rng.choice(letters) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        q, k = rng.randrange(1, 9), rng.randrange(3, 9)
        unit = [rng.choice(letters) for _ in range(q)]
        at = rng.randrange(len(words) + 1)
        words[at:at] = (unit * k)[: q * k - rng.randrange(q)]
    return words


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_equal_brute_force():
    rng = random.Random(11)
    texts = [[w.encode() for w in sample(rng, i % 3)] for i in range(900)]
    texts += [[b"x"] * n for n in (0, 1, 5, 6, 7, 300)]
    texts += [[w.encode() for w in fibonacci(400)], [b"a", b"b"] * 90 + [b"a"] * 77 + [b"c", b"a", b"b"] * 4]
    found = find_runs(texts)
    for words, runs in zip(texts, found, strict=True):
        assert [tuple(r) for r in runs.tolist()] == brute(words)
    assert sum(map(len, found)) > 700


def test_slices_do_not_change_results(monkeypatch):
    rng = random.Random(12)
    texts = [[w.encode() for w in sample(rng, i % 2)] for i in range(120)] + [[b"x"] * 200]
    want = [r.tolist() for r in find_runs(texts)]
    monkeypatch.setattr(recompression, "SLICE", 7)
    assert [r.tolist() for r in find_runs(texts)] == want


def test_extensions_are_exact_and_short():
    rng = np.random.default_rng(3)
    line = np.concatenate(([-1], rng.integers(0, 2, 400), np.tile(rng.integers(0, 4, 13), 60), np.zeros(500, dtype=np.int64), [-2], rng.integers(0, 3, 200), [-3]))
    grammar = Grammar(line)
    a, b = rng.integers(1, len(line) - 1, (2, 4000))
    a, b = a[a != b], b[a != b]
    far = grammar.extension(a, b, 1), grammar.extension(a, b, -1)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        n = 0
        while line[x + n] == line[y + n]:
            n += 1
        m = 0
        while line[x - m] == line[y - m]:
            m += 1
        assert (far[0][i], far[1][i]) == (n, m)


def test_long_text_of_one_word_is_one_run():
    (runs,) = find_runs([[b"w"] * 60_000])
    assert runs.tolist() == [[0, 60_000, 1]]


def test_query_columns(spark):
    rng = random.Random(13)
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(sample(rng, i % 3))) for i in range(300)]
    rows += [(None, "a b " * 9), (7, None), (8, ""), (9, " \x0b\x0c\r"), (5, rows[5][1]), (901, "é é é é é é É"), (902, "a b " * 20)]
    h = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows += [(h, "one two three four five six seven"), (h, ""), (h, "w"), (h, None)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, runs string, n long").repartition(3)
    got = recompression.digests(recompression.periodic_runs(recompression.with_periods(frame))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(*r) for r in rows), key=str)
    assert recompression.digests(recompression.periodic_runs(recompression.with_periods(frame.limit(0)))).collect() == []
