"""Sample roll-ups: edge cases, brute force for the query history."""

import random

import pytest

from tidemark.streaming import samples


def clip(text, limit):
    out = b""
    for c in text:
        if len(out) + len(c.encode()) > limit:
            break
        out += c.encode()
    return out.decode()


def fold(queries, history=1000, longest=100):
    done = ""
    for q in queries:
        room = min(history - 1 - len(done.encode()), longest)
        if len(q.encode()) > room:
            head = clip(q, room - 4) if room > 4 else ""
            done += head + "...;" if head else ""
        else:
            done += q if q.endswith(";") else q + ";"
    return done


def histories(rows, spark, **options):
    frame = spark.createDataFrame(rows, "instid long, pid long, xact long, executed_at long, query string").repartition(3)
    return {(r.pid, r.xact): r.queries for r in samples.xact_query_history(frame, **options).collect()}


def test_no_query_is_lost_behind_ones_that_never_fit(spark):
    queries = ["a" * 98] * 9 + ["b" * 91] + ["\U0001F600xxxxx"] * 1500 + ["abcdefgh"]
    rows = [(1, 1, 1, i, q) for i, q in enumerate(queries)]
    for k in range(90, 108):  # whatever room is left at the end
        rows += [(1, 2, k, i, q) for i, q in enumerate(["a" * 98] * 9 + ["b" * k] + ["€xyzuvw"] * 1100 + ["abcdefgh", ";", ""])]
    got = histories(rows, spark)
    for key in {(r[1], r[2]) for r in rows}:
        assert got[key] == fold([q for _, p, x, _, q in sorted(rows, key=lambda r: r[3]) if (p, x) == key])


@pytest.mark.parametrize("history, longest", [(1000, 100), (60, 20), (37, 9), (12, 50)])
def test_history_equals_plain_fold(spark, history, longest):
    rng = random.Random(history)
    rows = []
    for x in range(60):
        for i in range(rng.choice([1, 5, 40, 160])):
            q = "".join(rng.choice("a;é€\U0001F600b") for _ in range(rng.choice([0, 1, 2, 3, 7, 20, 130])))
            rows.append((1, x % 4, x, i, q))
    rows += [(1, 9, 900, 0, "x" * 300000), (1, 9, 900, 1, None), (1, 9, 901, 0, None)]
    got = histories(rows, spark, history_limit=history, query_limit=longest)
    assert len(got) == 62
    for p, x in got:
        own = [q or "" for _, a, b, _, q in rows if (a, b) == (p, x)]
        assert got[p, x] == fold(own, history, longest)
        assert len(got[p, x].encode()) <= history


def test_commands_can_be_left_out(spark):
    rows = [(1, 1, 1, i, q) for i, q in enumerate(["BEGIN", "SELECT 1", "savepoint a", "beginning", "COMMIT;"])]
    assert histories(rows, spark)[1, 1] == "BEGIN;SELECT 1;savepoint a;beginning;COMMIT;"
    assert histories(rows, spark, record_commands=False)[1, 1] == "SELECT 1;beginning;"
    assert histories(rows[:0], spark) == {}


def plain_transactions(rows):
    """Number of the transaction of every statement, session by session."""
    out, sessions = [], {}
    for instid, pid, at, query in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[3] is not None, r[3] or "")):
        word = " ".join((query or "").lower().rstrip(";").split())
        if word.startswith(("savepoint", "release", "start transaction", "rollback to", "rollback work to")):
            continue
        own = sessions.setdefault((instid, pid), [0, False])
        if word == "begin":
            own[:] = [own[0] + 1, True]
        elif word in ("commit", "rollback", "end", "prepare transaction 'x'", "rollback prepared 'x'"):
            own[1] = False
        elif not own[1]:
            own[0] += 1
        out.append((instid, pid, at, query, own[0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [1, 7, 50, 10_000])
def test_transactions_equal_plain_scan(spark, width):
    rng = random.Random(width)
    words = ["BEGIN", " begin ;", "COMMIT", "Rollback;", "END", "PREPARE TRANSACTION 'x'", "rollback prepared 'x'", "SAVEPOINT a",
             "rollback work to a", "ROLLBACK TO a", "release a", "START TRANSACTION", "beginning", "commits", "", None, "select 1", "x", "y"]
    rows = [(1, i % 5, rng.randrange(120), rng.choice(words)) for i in range(300)]
    rows += [(1, 99, i // 2, rng.choice(words[12:] if i % 90 else words)) for i in range(2500)]  # a hot session, long without a command
    rows += [(None, 7, None, "BEGIN"), (None, 7, 3, "a"), (None, 7, 3, "b"), (None, 7, 90, "COMMIT"), (None, 7, 91, "c"), (2, 1, 5, "COMMIT")]
    frame = spark.createDataFrame(rows, "instid long, pid long, executed_at long, query string").repartition(3)
    got = samples.with_transactions(frame.withColumn("xact", frame.pid), width=width).collect()
    assert sorted(map(tuple, got), key=str) == plain_transactions(rows)
    assert samples.with_transactions(frame.limit(0)).collect() == []


def test_histories_from_raw_statements(spark):
    rows = [(1, 1, i, q) for i, q in enumerate(["a", "BEGIN", "b", "savepoint s", "c", "COMMIT", "d", "ROLLBACK"])]
    raw = spark.createDataFrame(rows, "instid long, pid long, executed_at long, query string")
    timed = raw.withColumn("executed_at", raw.executed_at.cast("timestamp"))
    for frame in (raw, timed):
        got = samples.xact_query_history(samples.with_transactions(frame, width=3_000_000))
        assert {r.xact: r.queries for r in got.collect()} == {1: "a;", 2: "BEGIN;b;c;COMMIT;", 3: "d;ROLLBACK;"}
