"""Best-fit packing into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import n_words, stored

LENGTHS = (512, 1024, 2048, 4096, 8192)
BLOCK = 8192  # pieces packed together at most
BLOCKS = 64  # blocks of one task in large tables
#: Cost of a sequence of c words: a fixed part, its words, and attention growing with the square.
FIXED, SQUARE = 64.0, 1 / 16384


def cost(length: int) -> float:
    return FIXED + length + length * length * SQUARE


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the final length of each bin; no piece is longer than the largest length.

    Pieces come in descending size (ties by position).  Each goes into the open bin that it leaves least room in (ties:
    the oldest).  If none has room, a bin is opened in the permitted length of least cost per word that it could hold,
    given the words still to come; an equal one goes to the shorter.  At the end every bin shrinks to the
    shortest permitted length that holds its contents.
    """
    lengths = sorted(lengths)
    costs = [cost(c) for c in lengths]
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left = sum(sizes)
    room: list[tuple[int, int]] = []  # (room, bin) of open bins
    used: list[int] = []
    at, offset = [0] * len(sizes), [0] * len(sizes)
    for i in order:
        size = sizes[i]
        k = bisect_left(room, (size, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            first = bisect_left(lengths, size)
            best = min(range(first, len(lengths)), key=lambda j: (costs[j] / max(1, min(lengths[j], left)), lengths[j]))
            free, b = lengths[best], len(used)
            used.append(0)
        at[i], offset[i] = b, used[b]
        used[b] += size
        left -= size
        if free > size:
            insort(room, (free - size, b))
    return at, offset, [lengths[bisect_left(lengths, u)] for u in used]


def pieces(docs: DataFrame, longest: int) -> DataFrame:
    """``doc_id, n_words, h, piece, start, size`` (``h``: hash of id and text): documents cut every ``longest`` words; a wordless one is a piece of size 0."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", n_words(text).alias("n_words"), F.xxhash64("doc_id", text).alias("h"))
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n_words") - 1) / longest)).cast("int"))
    rows = rows.select("doc_id", "n_words", "h", F.explode(cuts).alias("piece"))
    start = F.col("piece").cast("long") * longest
    return rows.withColumn("start", start).withColumn("size", F.least(F.lit(longest).cast("long"), F.col("n_words") - F.col("start")))


def packed(docs: DataFrame, lengths: Sequence[int] = LENGTHS, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """Where each piece of ``docs(doc_id, text)`` goes: ``doc_id, piece, start, size, sequence_id, offset, sequence_length``.

    Sizes are words.  Texts longer than the largest permitted length are cut into pieces (``start`` is a piece's
    first word); the others stay whole.  Pieces are spread by a hash of id and text over as many partitions as there are
    blocks (``parts``: other than that), so texts that share an id do not meet, and packed in blocks of ``block`` at most, so a
    task's memory is bounded however many rows are equal.  ``sequence_id`` names partition,
    block and bin.  Null and empty texts are pieces of size 0 and take no room; rows without an id are packed; repeated
    rows are packed each; extra columns are ignored; an empty table gives an empty result.
    """
    lengths = tuple(sorted(lengths))
    rows = pieces(docs, lengths[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, n = TaskContext.get().partitionId(), 0, [], 0

        def flush(table: pa.Table) -> pa.RecordBatch:
            at, offset, final = pack(table["size"].to_pylist(), lengths)
            at_ = np.array(at, dtype=np.int64)
            names = at_ + (np.int64(part) << 40) + (np.int64(number) << 20)
            columns = [table[c].combine_chunks() for c in ("doc_id", "piece", "start", "size")]
            columns += [pa.array(names), pa.array(np.array(offset, dtype=np.int64)), pa.array(np.array(final, dtype=np.int64)[at_])]
            return pa.RecordBatch.from_arrays(columns, [*("doc_id", "piece", "start", "size"), "sequence_id", "offset", "sequence_length"])

        for batch in batches:
            held.append(batch)
            n += len(batch)
            while n >= block:
                table = pa.Table.from_batches(held)
                yield flush(table.slice(0, block))
                held, n, number = table.slice(block).to_batches(), n - block, number + 1
        if n:
            yield flush(pa.Table.from_batches(held))

    kind = rows.schema["doc_id"].dataType.simpleString()
    if parts is None:
        rows = stored(rows.select("doc_id", "piece", "start", "size", "h"), "pieces")
        blocks = -(-rows.count() // block)
        # a task packs one block, and many only when there would be far more tasks than shuffle partitions
        parts = min(blocks, max(-(-blocks // BLOCKS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.repartition(max(1, parts), F.xxhash64("h", "piece")).sortWithinPartitions("doc_id", "piece", "size", "h")
    rows = rows.select("doc_id", "piece", "start", "size")
    return rows.mapInArrow(
        run, f"doc_id {kind}, piece int, start long, size long, sequence_id long, offset long, sequence_length long"
    )
