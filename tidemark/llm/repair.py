"""Conversation structure repair by Knuth's lightest derivations.

A conversation is legal if its role initials read ``(s?(ua)+)?``.  An item says that rows up to a place were consumed and the
initials written so far have led to a state; keeping, re-roling, deleting and inserting are deductions that extend an
item's (cost, audit).  Each is superior (cost and audit only grow) and monotone (two audits of one item and one cost are
never prefixes of each other, as an extra insertion costs), so an agenda that pops the least (cost, audit) finalises
every item once.  Long conversations are cut into chunks: the agenda of a chunk derives its lightest way from each state to
each state, and a second deduction over whole chunks joins them.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

SPACE = " \t\n\x0b\f\r"
SHIFT = 10  # rows of a chunk: 2 ** SHIFT at most
#: Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing written, a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Where a row of the role that fits next (user or assistant) leads, and what ends a conversation in a state.
NEXT = (USER, USER, ASSISTANT, USER)
ENDING = ("", "II", "I", "")


@lru_cache(maxsize=4096)
def lightest(rows: tuple[str, ...], entry: int) -> tuple[tuple[int, int, str] | None, ...]:
    """Least (cost, audit) with which ``rows`` lead from ``entry`` to each state; insertions come before a row only.

    A row is its role's initial (x: another) and ``.`` (good), ``t`` (truncated) or ``-`` (to be deleted).
    """
    n, final = len(rows), {}
    agenda = [(0, "", 0, entry)]
    while agenda:
        cost, audit, at, state = heapq.heappop(agenda)
        if (at, state) in final:
            continue
        final[at, state] = cost, audit
        if at == n:
            continue
        initial, fault = rows[at]
        steps = [(INSERT, "I", at, NEXT[state]), (DELETE, "D", at + 1, state)]
        if fault != "-":
            extra = TRUNCATED if fault == "t" else 0
            steps.append((REROLE + extra, "R", at + 1, NEXT[state]))
            if (state, initial) in KEPT:
                steps.append((KEEP + extra, "K", at + 1, KEPT[state, initial]))
        for more, letter, to, then in steps:
            if (to, then) not in final:
                heapq.heappush(agenda, (cost + more, audit + letter, to, then))
    return tuple(final.get((n, state)) for state in range(4))


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in order, with their place ``at`` in the whole table and what the agenda has to know of them."""
    rows = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    end = F.substring(_trimmed(F.col("text")), -1, 1)
    initial = F.substring("role", 1, 1)
    rows = rows.withColumn("start", F.substring("text", 1, 64))
    # a conversation of many rows is spread over partitions; places follow the order across them
    rows = rows.repartitionByRange("conv_id", "turn", "role", "start").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select(
        "conv_id",
        F.monotonically_increasing_id().alias("at"),
        "role",
        "text",
        F.concat(
            F.when(initial.isin("s", "u", "a"), initial).otherwise("x"),
            F.when(end == "", "b").when(end.isin(".", "!", "?"), ".").otherwise("t"),
        ).alias("code"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256).alias("same"),
    )


_WAY = pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
WAYS = "array<struct<entry: int, leave: int, cost: bigint, audit: string>>"
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and lightest ways of every chunk."""
    for batch in batches:
        out = {k: [] for k in (*COUNTS, "first", "last", "ways")}
        for marks in batch.column("marks"):
            seen: dict[int, set] = {}
            for m in marks.as_py():
                seen.setdefault(m["at"], set()).add(m["mark"])
            rows, count = [], dict.fromkeys(COUNTS, 0)
            for at in sorted(seen):
                first = "!" in seen[at]
                initial, state = max(seen[at])  # a code; "!" sorts below letters
                fault = "blank" if state == "b" else "truncated" if state == "t" else None
                if state != "b" and not first:
                    fault = "duplicate"
                if fault:
                    count[fault] += 1
                if rows and rows[-1][0] + initial not in ("su", "ua", "au"):
                    count["illegal"] += 1
                rows.append(initial + ("-" if fault in ("blank", "duplicate") else state))
            ways = []
            for entry in range(4):
                for leave, found in enumerate(lightest(tuple(rows), entry)):
                    if found:
                        ways.append({"entry": entry, "leave": leave, "cost": found[0], "audit": found[1]})
            ways.sort(key=lambda w: w["audit"])
            for k, v in (*count.items(), ("first", rows[0][0]), ("last", rows[-1][0]), ("ways", ways)):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("chunk"), *(pa.array(out[k], pa.int64()) for k in COUNTS), pa.array(out["first"], pa.string()), pa.array(out["last"], pa.string()), pa.array(out["ways"], pa.list_(_WAY))],
            names=["conv_id", "chunk", *COUNTS, "first", "last", "ways"],
        )


class _Chain:
    """Lightest derivations over the chunks of one conversation: four open ends and four way numbers a chunk."""

    def __init__(self):
        self.ends = {START: (0, 0)}  # state: cost, order of the audit among the ends
        self.back: list[dict[int, tuple[int, int]]] = []
        self.chunks: list[int] = []
        self.totals = [0] * len(COUNTS)
        self.last: str | None = None

    def add(self, chunk: int, counts: list[int], first: str, last: str, ways: list[dict]) -> None:
        self.chunks.append(chunk)
        self.totals = [a + b for a, b in zip(self.totals, counts, strict=True)]
        if self.last is not None and self.last + first not in ("su", "ua", "au"):
            self.totals[-1] += 1
        self.last = last
        best: dict[int, tuple] = {}
        rank, before = -1, None
        for number, way in enumerate(ways):  # sorted by audit
            rank, before = rank + (way["audit"] != before), way["audit"]
            if way["entry"] in self.ends:
                cost, order = self.ends[way["entry"]]
                found = (cost + way["cost"], order, rank, number, way["entry"])
                if way["leave"] not in best or found < best[way["leave"]]:
                    best[way["leave"]] = found
        places = {pair: i for i, pair in enumerate(sorted({b[1:3] for b in best.values()}))}
        self.ends = {state: (b[0], places[b[1:3]]) for state, b in best.items()}
        self.back.append({state: (b[3], b[4]) for state, b in best.items()})

    def result(self) -> tuple[list[int], int, str]:
        """The way taken through each chunk, the cost and the closing insertions."""
        cost, _, state = min((c + INSERT * len(ENDING[s]), order, s) for s, (c, order) in self.ends.items())
        end, numbers = ENDING[state], []
        for step in reversed(self.back):
            number, state = step[state]
            numbers.append(number)
        return numbers[::-1], cost, end


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The way taken through every chunk; a conversation's last chunk also bears its totals and closing insertions."""
    chain, conv, kind = None, None, None

    def flushed(chain: _Chain, conv, kind: pa.DataType) -> pa.RecordBatch:
        numbers, cost, end = chain.result()
        n = len(numbers)
        lone = [None] * (n - 1)
        return pa.RecordBatch.from_arrays(
            [pa.array([conv] * n, kind), pa.array(chain.chunks, pa.int64()), pa.array(numbers, pa.int32()), pa.array([*lone, end], pa.string())]
            + [pa.array([*lone, t], pa.int64()) for t in (cost, *chain.totals)],
            names=["conv_id", "chunk", "way", "end", "cost", *COUNTS],
        )

    for batch in batches:
        kind = batch.column("conv_id").type
        for r in batch.to_pylist():
            if chain is None or r["conv_id"] != conv:
                if chain is not None:
                    yield flushed(chain, conv, kind)
                chain, conv = _Chain(), r["conv_id"]
            chain.add(r["chunk"], [r[c] for c in COUNTS], r["first"], r["last"], r["ways"])
    if chain is not None:
        yield flushed(chain, conv, kind)


class Repair:
    """``plans``: one row per conversation; ``repaired``: its repaired rows."""

    def __init__(self, rows: DataFrame, shift: int = SHIFT):
        self.kind = rows.schema["conv_id"].dataType.simpleString()
        self.rows = stored(_ordered(rows), "turns").withColumn("chunk", F.shiftright("at", shift))
        light = self.rows.select("conv_id", "chunk", "at", "code", "same")
        # the first row of each role and text; all later ones are duplicates
        first = light.groupBy("conv_id", "same").agg(F.min(F.struct("at", "chunk")).alias("m"))
        marks = light.select("conv_id", "chunk", "at", F.col("code").alias("mark")).unionByName(
            first.select("conv_id", "m.chunk", "m.at", F.lit("!").alias("mark"))
        )
        chunks = marks.groupBy("conv_id", "chunk").agg(F.collect_list(F.struct("at", "mark")).alias("marks"))
        counts = ", ".join(f"{c} bigint" for c in COUNTS)
        self.chunks = stored(
            chunks.mapInArrow(_solved, f"conv_id {self.kind}, chunk bigint, {counts}, first string, last string, ways {WAYS}"), "chunks"
        )
        together = self.chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
        chained = together.mapInArrow(_chained, f"conv_id {self.kind}, chunk bigint, way int, end string, cost bigint, {counts}")
        taken = chained.alias("t").join(
            self.chunks.select("conv_id", "chunk", "ways").alias("c"), F.expr("t.conv_id <=> c.conv_id AND t.chunk = c.chunk")
        )
        way = F.expr("c.ways[t.way]")
        self.taken = stored(taken.select("t.*", way["entry"].alias("entry"), way["audit"].alias("audit")), "taken")

    def plans(self) -> DataFrame:
        """``conv_id, blank, duplicate, truncated, illegal, cost, audit``."""
        pieces = F.array_sort(F.collect_list(F.struct("chunk", F.concat("audit", F.coalesce("end", F.lit(""))).alias("audit"))))
        return self.taken.groupBy("conv_id").agg(
            *(F.max(c).alias(c) for c in (*COUNTS, "cost")), F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit")
        )

    def repaired(self, together: bool = False) -> DataFrame:
        """``conv_id, at, edit, role, text`` of the rows that stay or are inserted, in order within each partition.

        Chunks are repaired apart, so a long conversation takes many tasks; ``together`` puts each conversation into one
        partition instead, which streams it.
        """
        none = F.lit(None).cast("string")
        rows = self.rows.select("conv_id", "chunk", "at", "role", "text", none.alias("audit"), none.alias("end"), F.lit(None).cast("int").alias("entry"))
        heads = self.taken.select("conv_id", "chunk", F.lit(None).cast("bigint").alias("at"), none.alias("role"), none.alias("text"), "audit", "end", "entry")
        rows = rows.unionByName(heads).repartition(*(["conv_id"] if together else ["conv_id", "chunk"]))
        rows = rows.sortWithinPartitions("conv_id", "chunk", "at")  # a chunk's head has no place and comes first
        return rows.mapInArrow(_written, f"conv_id {self.kind}, at bigint, edit string, role string, text string")


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows from chunks whose heads say the audit."""
    names = ["conv_id", "at", "edit", "role", "text"]
    audit, place, state, end, left = "", 0, START, None, 0
    for batch in batches:
        kind = batch.column("conv_id").type
        out = []

        def insert(count: int, conv, at: int, state: int) -> int:
            for _ in range(count):
                state = NEXT[state]
                out.append((conv, at, "I", "user" if state == USER else "assistant", ""))
            return state

        for r in batch.to_pylist():
            conv = r["conv_id"]
            if r["at"] is None:
                audit, place, state, end = r["audit"], 0, r["entry"], r["end"]
                left = sum(c != "I" for c in audit)
                continue
            stop = place
            while audit[stop] == "I":
                stop += 1
            state = insert(stop - place, conv, r["at"], state)
            edit, place, left = audit[stop], stop + 1, left - 1
            if edit == "K":
                state = KEPT[state, r["role"][0]]
                out.append((conv, r["at"], edit, r["role"], r["text"]))
            elif edit == "R":
                state = NEXT[state]
                out.append((conv, r["at"], edit, "user" if state == USER else "assistant", r["text"]))
            if left == 0 and end:
                state = insert(len(end), conv, r["at"], state)
        columns = zip(*out, strict=True) if out else [()] * len(names)
        kinds = (kind, pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, conv, digest = [], None, None
    kind = None
    for batch in batches:
        kind = batch.column("conv_id").type
        for r in batch.to_pylist():
            if digest is None or r["conv_id"] != conv:
                if digest is not None:
                    found.append((conv, digest.hexdigest()))
                conv, digest = r["conv_id"], hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{r['role']}:{r['text']}".encode())
        if len(found) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found])], names=["conv_id", "repaired_sha256"])
            found = []
    if digest is not None:
        found.append((conv, digest.hexdigest()))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found])], names=["conv_id", "repaired_sha256"])


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults set by crc32(``conv_id:turn``) % 20 and the number of ``copies`` of each row.

    0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 doubles it, 4 makes it a user's; nulls read as one space.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.withColumn("fault", F.crc32(name.cast("binary")) % 20)
    text, role = F.coalesce(F.col("text").cast("string"), blank), F.coalesce(F.col("role").cast("string"), blank)
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("copies"),
    )


def repair(conversations: DataFrame, shift: int = SHIFT) -> DataFrame:
    """Damage every conversation, repair it and report: one row per original ``conv_id``, a null one included.

    Rows stand in order of turn (null first), role and text; what ties beyond that is equal.  Role initials are compared as they are, and
    an empty role has none, so such a row is re-roled or deleted.  Conversations of any length are repaired in chunks of
    1024 rows; only the hash of the repaired text is computed in one task per conversation, row by row.  An empty
    table gives an empty result; extra columns are ignored; ``gaps`` beyond 64 bits is null.
    """
    rows = damaged(conversations)
    there = F.when(F.col("copies") > 0, F.col("turn"))
    spans = rows.groupBy("conv_id").agg(F.max(there).alias("b"), F.min(there).alias("a"), F.countDistinct(there).alias("n"))
    gaps = F.expr("CASE WHEN n = 0 THEN 0L ELSE try_cast(CAST(b AS DECIMAL(30)) - CAST(a AS DECIMAL(30)) + 1 - n AS BIGINT) END")
    copied = rows.withColumn("copy", F.explode(F.expr("array_repeat(0, copies)"))).drop("copies", "copy")
    found = Repair(copied, shift)
    hashes = found.repaired(together=True).mapInArrow(_hashed, f"conv_id {found.kind}, repaired_sha256 string")
    out = spans.select("conv_id", gaps.alias("gaps")).alias("s")
    out = out.join(found.plans().alias("p"), F.expr("s.conv_id <=> p.conv_id"), "left").drop(F.col("p.conv_id"))
    out = out.join(hashes.alias("h"), F.expr("s.conv_id <=> h.conv_id"), "left")
    return out.select(
        "s.conv_id",
        "gaps",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*COUNTS, "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
