"""Temporal list join against brute force."""

import random

import pytest

from tidemark.llm import urllist

PAGES = "page_id long, url string, fetched long, key string, action string, since string"
DAY = 86400


def brute(url, fetched, entries):
    if url is None or "://" not in url or fetched is None:
        return None
    rest = url.split("://", 1)[1]
    for c in "?#":
        rest = rest.split(c, 1)[0]
    host, _, path = rest.partition("/")
    host = host.rsplit("@", 1)[-1].split(":")[0].lower().rstrip(".")
    if not host:
        return None
    names, parts = host.split("."), [p.lower() for p in path.split("/") if p][:2]
    keys = [".".join(names[i:]) + "".join("/" + p for p in parts[:j]) for i in range(len(names)) for j in range(len(parts) + 1)]
    hits = []
    for k in set(keys):
        past = [(at, action) for key, at, action in entries if key is not None and key.lower() == k and at is not None and action is not None and at <= fetched]
        if past:
            last = max(past)
            if last[1] != "none":
                hits.append((-len(k), k, last[1], last[0]))
    return min(hits)[1:] if hits else None


@pytest.mark.parametrize("epoch", [DAY // 7, 30 * DAY])
def test_as_of_join(spark, epoch):
    rng = random.Random(6)
    hosts = ["a.com", "x.a.com", "B.org", "deep.y.b.org", "c.net"]
    keys = ["a.com", "x.A.com", "b.org", "y.b.org", "c.net/p", "a.com/p/q", "com", "c.net"]
    entries = [(rng.choice(keys), rng.randrange(0, 90) * DAY, rng.choice(["block", "allow", "none", "warn"])) for _ in range(60)]
    entries += entries[:5] + [(None, 5, "block"), ("a.com", None, "block"), ("a.com", 7, None)]
    pages = []
    for i in range(300):
        url = f"http{rng.choice(['', 's'])}://{rng.choice(['', 'me@'])}{rng.choice(hosts)}{rng.choice(['', ':80', '.'])}{rng.choice(['', '/', '/p', '/P/q/r', '/p?x=/z', '//p', '#/p'])}"
        pages.append((i, url, rng.randrange(-5, 100) * DAY + rng.choice([0, 1, -1])))
    pages += [(900, None, 5), (901, "", 5), (902, "no url", 5), (903, "http://", 9), (904, "http://a.com", None), (None, "http://a.com/p", 50 * DAY), (3, *pages[3][1:])]
    pages.append((905, "https://a.com/" + "p/" * 20000, 50 * DAY))
    frame = spark.createDataFrame([(*p, "", "", "") for p in pages], PAGES)
    listed = spark.createDataFrame(entries, "key string, at long, action string")
    got = urllist.matched(frame.repartition(3), listed, epoch).collect()
    assert len(got) == len(pages)
    for r in got:
        m = brute(r.url, r.fetched, entries)
        assert ((r.matched_key, r.action, r.since) if m else None) == m, r
        assert m is not None or r.matched_key is None
        assert r.kept == (m is None or m[1] == "allow")
    assert any(r.action == "block" for r in got) and any(r.action == "allow" for r in got)
    assert urllist.matched(frame.limit(0), listed).collect() == []
    assert all(r.kept for r in urllist.matched(frame, listed.limit(0)).collect())


def test_keys_of_many_path_parts(spark):
    entries = [("a.com/p/q/r", 1, "block"), ("a.com/p/q/r/s/T/u", 1, "allow"), ("b.org/x", 1, "block"), ("b.org/x/y/z", 1, "allow"), ("b.org/x/y/z", 9, "none")]
    want = {
        "http://a.com/p/q": None, "http://w.a.com/P/q//R": "a.com/p/q/r", "http://a.com/p/q/r/s/t": "a.com/p/q/r", "http://a.com/p/q/rr": None,
        "http://a.com/p/q/r/s/t/u/v?x": "a.com/p/q/r/s/t/u", "http://b.org/x/y/z/1": "b.org/x/y/z", "http://b.org/x/y": "b.org/x",
    }
    pages = [(i, url, 5, "", "", "") for i, url in enumerate(want)] + [(99, "http://b.org/x/y/z", 9, "", "", "")]
    got = urllist.matched(spark.createDataFrame(pages, PAGES), spark.createDataFrame(entries, "key string, at long, action string")).collect()
    assert {r.url: r.matched_key for r in got} == want | {"http://b.org/x/y/z": "b.org/x"}
    assert all(r.kept == (r.matched_key in (None, "a.com/p/q/r/s/t/u", "b.org/x/y/z")) for r in got)


def test_intervals_are_disjoint(spark):
    entries = [("K", 1, "block"), ("k", 1, "allow"), ("k", 5, "block"), ("k", 5, "block"), ("k", 9, "none"), ("k", 12, "warn")]
    got = sorted(map(tuple, urllist.intervals(spark.createDataFrame(entries, "key string, at long, action string")).collect()), key=str)
    assert got == [("k", "block", 1, 5), ("k", "block", 5, 9), ("k", "warn", 12, None)]


def test_forms_of_keys(spark):
    entries = [("b.com/", 1, "block"), ("http://C.com", 1, "block"), ("https://d.com./p//q/", 1, "block"), ("//", 1, "block"), ("", 1, "block"), ("/x", 1, "block")]
    want = {"http://b.com/x": "b.com", "http://w.c.com": "c.com", "http://d.com/P/q/r": "d.com/p/q", "http://d.com/p": None, "http://x": None}
    pages = [(i, url, 5, "", "", "") for i, url in enumerate(want)]
    got = urllist.matched(spark.createDataFrame(pages, PAGES), spark.createDataFrame(entries, "key string, at long, action string")).collect()
    assert {r.url: r.matched_key for r in got} == want


@pytest.mark.parametrize("epochs", [2, 1024])
def test_far_times_cost_no_epochs(spark, epochs, monkeypatch):
    """One capture of the year 9999 adds its own epoch, not all between; wide epochs give the same verdicts."""
    monkeypatch.setattr(urllist, "EPOCHS", epochs)
    far = 253370764800
    entries = [(f"h{i % 50}.com", i * DAY, ["block", "none", "allow"][i % 3]) for i in range(200)]
    pages = [(i, f"http://h{i % 60}.com/", i * DAY // 2, "", "", "") for i in range(300)] + [(900, "http://h0.com", far, "", "", "")]
    frame = spark.createDataFrame(pages, PAGES)
    out = urllist.matched(frame, spark.createDataFrame(entries, "key string, at long, action string"))
    got = {r.page_id: (r.matched_key, r.action, r.since) if r.matched_key else None for r in out.collect()}
    assert got == {p[0]: brute(p[1], p[2], entries) for p in pages}
    assert got[900] == ("h0.com", "block", 150 * DAY)
    width, seen = urllist.occurring_epochs(frame, urllist.EPOCH)
    assert len(seen) <= (2 if epochs == 2 else 7) and (width > urllist.EPOCH) == (epochs == 2)
