"""Katz backoff scoring with Good-Turing discounts, from bigram counts partitioned by context."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, stored
from tidemark.llm.words import mixed, pieces, word_hashes

END, START = np.uint64(1), np.uint64(2)  # tokens that no word's hash is taken for
CLEAR = 5  # counts up to this are discounted by Good-Turing
LARGE = 0.01  # taken off larger counts, so that every context leaves some mass
HOT = 1 << 20  # frequent words known to every task at most
TOP = 4096  # contexts whose pairs are spread over all buckets at most
RUN = 1 << 22  # bytes of text packed together
DOCS = 1 << 16  # documents packed together at most
BUCKET = 1_200_000  # tokens of a bucket aimed at


def discounted(n: np.ndarray) -> np.ndarray:
    """Discounted counts of 1 to ``CLEAR`` from ``n``: how many types occur 1 to ``CLEAR`` + 1 times.

    Good-Turing in Katz's form; where the counts of counts do not allow it, absolute discounting.
    """
    k, n = CLEAR, np.asarray(n, dtype=float)
    r = np.arange(1, k + 1)
    if (n[:k] > 0).all():
        tail = (k + 1) * n[k] / n[0]
        if tail < 1:
            d = ((r + 1) * n[1:] / (r * n[:k]) - tail) / (1 - tail)
            if ((d > 0) & (d < 1)).all():
                return d * r
    return r - (float(np.clip(n[0] / (n[0] + 2 * n[1]), 0.1, 0.9)) if n[0] > 0 and n[1] > 0 else 0.5)


@dataclass
class Unigrams:
    """Totals of the training tokens and the frequent words, sorted by hash."""

    total: int
    types: int
    ends: int
    star: np.ndarray
    unknown: float  # probability of all unknown words together, scored as one
    hot: np.ndarray
    hot_counts: np.ndarray
    top: np.ndarray

    def probability(self, c: np.ndarray) -> np.ndarray:
        c = np.asarray(c)
        star = np.where(c <= CLEAR, np.concatenate(([0.0], self.star))[np.minimum(c, CLEAR)], c - LARGE)
        return np.where(c > 0, star / max(self.total, 1), self.unknown)

    def probability_column(self, c: Column) -> Column:
        out = F.when(c > CLEAR, (c - LARGE) / max(self.total, 1))
        for r, star in enumerate(self.star.tolist(), 1):
            out = out.when(c == r, star / max(self.total, 1))
        return out.otherwise(self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.types + 1)))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place among the frequent words, or -1."""
        if not len(self.hot):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)
        return np.where(self.hot[at] == h, at, -1)


def word_counts(docs: DataFrame) -> DataFrame:
    """``h, c``: hash of each token of the training rows of ``docs(text, held)`` and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            h, back = np.unique(np.concatenate(names), return_inverse=True)
            c = np.bincount(back, np.concatenate(counts), len(h)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

        names, counts, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            for _, texts in pieces(batch.column("text"), RUN):
                h, c = np.unique(word_hashes(texts)[0], return_counts=True)
                names += [h, np.array([END])]
                counts += [c, np.array([len(texts)])]
                size += len(h)
            if size > 3_000_000:
                yield out()
                names, counts, size = names[:1], counts[:1], 0
        yield out()

    rows = docs.where("NOT held").select("text").mapInArrow(run, "h long, c long")
    return stored(rows.groupBy("h").agg(F.sum("c").alias("c")), "words")


def unigrams(words: DataFrame, hot: int = HOT, top: int = TOP) -> Unigrams:
    """Totals, discounts and the frequent words: all of at least the count that ``hot`` words reach.

    Counts are told apart up to 65 536 and by powers of two beyond, so the histogram is bounded.  Where so many words share the
    first count that it alone passes ``hot``, a part of them by hash is taken; the ``top`` most frequent always are.
    """
    cap = 1 << 16
    step = F.when(F.col("c") <= cap, F.col("c")).otherwise(F.expr("shiftleft(1L, CAST(floor(log2(c)) AS INT))"))
    rows = words.withColumn("step", step)
    histogram = rows.groupBy("step").agg(F.count("*").alias("n"), F.sum("c").alias("t")).collect()
    by = {r.step: r.n for r in histogram}  # 65 536 rows and one for each power of two at most
    total, types = sum(r.t for r in histogram), sum(by.values())
    seen, least = 0, None
    for c in sorted(by, reverse=True):
        if seen + by[c] > hot:
            break
        seen, least = seen + by[c], c
    some = words.where(F.col("h") != int(END))
    if least is not None:
        taken = some.where(F.col("c") >= least)  # ``hot`` rows at most
    elif by:
        first = max(by)
        part = F.pmod(F.xxhash64("h"), F.lit(by[first])) < hot * 9 // 10
        taken = rows.where((F.col("h") != int(END)) & (F.col("step") == first) & part).select("h", "c").limit(hot)
    else:
        taken = some.limit(0)
    if least is None or seen < top:
        taken = taken.select("h", "c").union(some.orderBy(F.desc("c"), "h").limit(top).select("h", "c")).distinct()
    table = taken.toArrow()  # ``hot`` + ``top`` rows at most
    h, c = table["h"].to_numpy().view(np.uint64), table["c"].to_numpy()
    order = np.argsort(h)
    h, c = h[order], c[order]
    star = discounted(np.array([by.get(r, 0) for r in range(1, CLEAR + 2)]))
    taken = sum(by.get(r, 0) * (r - s) for r, s in enumerate(star.tolist(), 1))
    taken += LARGE * (types - sum(by.get(r, 0) for r in range(1, CLEAR + 1)))
    ends = words.where(F.col("h") == int(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    first = np.zeros(len(h), dtype=bool)
    first[np.argsort(-c, kind="stable")[:top]] = True
    return Unigrams(total, types, ends, star, taken / total if total else 1.0, h, c, first)


_IN = "bucket int, run long, place int, doc_id {kind}, held boolean, n_tokens long, known long, base double, score double, blob binary"


def _packer(uni: Unigrams, buckets: int):
    """Texts to one row per document and, per run of documents and bucket, one packed table of (context, word, document, count).

    Words are named by their place among the frequent ones; others by their place in a list of hashes of their own.
    """
    n_hot = len(uni.hot)
    spread = np.uint64(buckets)

    def pack(texts: list[bytes], held: np.ndarray):
        h, owner = word_hashes(texts)
        docs = np.arange(len(texts))
        n = np.bincount(owner, minlength=len(texts))
        token = np.full(len(h) + len(texts), END, dtype=np.uint64)
        token[np.arange(len(h)) + owner] = h
        doc = np.repeat(docs, n + 1)
        names, back = np.unique(token, return_inverse=True)
        place = np.where((names == END) | (names == START), -1, uni.find(names))
        count = np.where(place >= 0, uni.hot_counts[place] if n_hot else 0, 0)
        count[names == END] = uni.ends
        sure = (place >= 0) | (names == END)  # counts known here; the others are known where the word is a context
        base = np.bincount(doc, np.where(sure, uni.base(count), 0.0)[back], len(texts))
        known = np.bincount(doc, (sure & (count > 0))[back], len(texts)).astype(np.int64)
        # rename: frequent words first, then START, END and the others, so that equal words are neighbours
        order = np.concatenate((np.flatnonzero(place >= 0), np.flatnonzero(names == END), np.flatnonzero((place < 0) & (names != END))))
        rank = np.empty(len(names), dtype=np.int64)
        rank[order] = np.arange(len(names))
        names, place = np.concatenate((names[order], [START])), np.concatenate((place[order], [-1]))
        width = np.int64(len(names))
        second = rank[back]
        first = np.concatenate(([width - 1], second[:-1]))
        first[np.cumsum(n + 1)[:-1]] = width - 1
        key, times = np.unique((first * width + second) * np.int64(DOCS) + doc, return_counts=True)
        doc, pair = key % DOCS, key // DOCS
        first, second = pair // width, pair % width
        # every pair is taken as seen here and divided by its context's count, where that is known
        of = np.concatenate((count[order], [uni.ends]))
        of = np.where(place >= 0, of, 0)
        of[-1] = uni.ends
        score = -np.bincount(doc, times * np.log10(np.maximum(of, 1))[first], len(texts))
        top = np.concatenate((np.where(place >= 0, uni.top[place] if n_hot else False, False)[:-1], [True]))
        spot = mixed(names[first] + np.where(top[first], mixed(names[second]), np.uint64(0)))
        bucket = (spot % spread).astype(np.uint32 if buckets > 65536 else np.uint16)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        code = np.where(place >= 0, place, n_hot + 1).astype(np.int64)
        code[names == START] = n_hot
        blobs = {}
        for b in np.flatnonzero(np.diff(edges)).tolist():
            at = order[edges[b] : edges[b + 1]]
            x, y = first[at], second[at]
            rare = np.unique(np.concatenate((x, y)))
            rare = rare[(place[rare] < 0) & (names[rare] != START)]
            cx, cy = (np.where((place[z] < 0) & (names[z] != START), n_hot + 1 + np.searchsorted(rare, z), code[z]) for z in (x, y))
            wide = np.uint8 if times[at].max() < 256 else np.uint32
            head = np.array([len(at), len(rare), len(texts), np.dtype(wide).itemsize], dtype=np.int64)
            blobs[b] = b"".join(
                z.tobytes() for z in (head, names[rare], np.diff(cx, prepend=0).astype(np.int32), cy.astype(np.int32),
                                      doc[at].astype(np.uint16), times[at].astype(wide), np.packbits(held))
            )
        return n + 1, known, base, score, blobs

    def home(run_: int) -> int:
        """Bucket of a run's first document row; the others follow in turn, as no bucket needs them."""
        return int(mixed(np.array([run_], dtype=np.uint64))[0] % spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held_rows: list[tuple] = []

        def flush():
            texts = [t for t, _, _ in held_rows]
            held = np.array([x for _, x, _ in held_rows], dtype=bool)
            tokens, known, base, score, blobs = pack(texts, held)
            run_, d, b = (part << 20) + number, len(texts), len(blobs)
            none = pa.nulls
            ids = pa.array([i for _, _, i in held_rows], kinds[0])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(((home(run_) + np.arange(d)) % buckets, np.fromiter(blobs, np.int64, b))).astype(np.int32)),
                    pa.array(np.full(d + b, run_, dtype=np.int64)),
                    pa.array(np.concatenate((np.arange(d), np.full(b, -1))).astype(np.int32)),
                    pa.concat_arrays([ids, none(b, kinds[0])]),
                    pa.concat_arrays([pa.array(held), none(b, pa.bool_())]),
                    pa.concat_arrays([pa.array(tokens.astype(np.int64)), none(b, pa.int64())]),
                    pa.concat_arrays([pa.array(known), none(b, pa.int64())]),
                    pa.concat_arrays([pa.array(base), none(b, pa.float64())]),
                    pa.concat_arrays([pa.array(score), none(b, pa.float64())]),
                    pa.concat_arrays([none(d, pa.binary()), pa.array(list(blobs.values()), pa.binary())]),
                ],
                ["bucket", "run", "place", "doc_id", "held", "n_tokens", "known", "base", "score", "blob"],
            )

        size, kinds = 0, [pa.int64()]
        for batch in batches:
            kinds[0] = batch.column("doc_id").type
            texts = batch.column("text").cast(pa.large_binary())
            for text, held, id_ in zip(texts, batch.column("held").to_pylist(), batch.column("doc_id").to_pylist()):
                text = text.as_py() or b""
                if held_rows and (size + len(text) > RUN or len(held_rows) == DOCS):
                    yield flush()
                    held_rows, size, number = [], 0, number + 1
                held_rows.append((text, held, id_))
                size += len(text)
        if held_rows:
            yield flush()

    return run


_OUT = (
    "kind int, run long, place int, doc_id {kind}, held boolean, n_tokens long, known long, base double, score double, blob binary, "
    "rid long, h1 long, h2 long, n long, q array<long>, den double"
)
_DOC, _PART, _CONTEXT, _FOLLOWER, _ALPHA, _WORD, _COUNTS = range(7)


def _counter(uni: Unigrams):
    """Counts the pairs of whole buckets; what it passes on is described in ``scores``."""
    n_hot = len(uni.hot)

    def unpack(blob: bytes):
        n, rare, docs, wide = np.frombuffer(blob, np.int64, 4)
        at = 32
        out, narrow = [], np.uint8 if wide == 1 else np.uint32
        for kind, size in ((np.uint64, rare), (np.int32, n), (np.int32, n), (np.uint16, n), (narrow, n), (np.uint8, (docs + 7) // 8)):
            out.append(np.frombuffer(blob, kind, size, at))
            at += size * np.dtype(kind).itemsize
        hashes, x, y, doc, times, held = out
        return hashes, np.cumsum(x, dtype=np.int64), y.astype(np.int64), doc.astype(np.int64), times.astype(np.int64), np.unpackbits(held)[: int(docs)].astype(bool)

    def hashed(code: np.ndarray, rare: np.ndarray) -> np.ndarray:
        out = np.full(len(code), START, dtype=np.uint64)
        frequent, other = code < n_hot, code > n_hot
        out[frequent] = uni.hot[code[frequent]]
        out[other] = rare[code[other] - n_hot - 1]
        return out

    def count(runs: np.ndarray, blobs: list[bytes]) -> dict[str, np.ndarray | list]:
        g1, g2, where, times, train = [], [], [], [], []
        for i, blob in enumerate(blobs):
            rare, x, y, doc, n, held = unpack(blob)
            g1.append(hashed(x, rare))
            g2.append(hashed(y, rare))
            where.append(i * DOCS + doc)
            times.append(n)
            train.append(~held[doc])
        g1, g2, where, times, train = (np.concatenate(z) for z in (g1, g2, where, times, train))
        key = mixed(g1 + mixed(g2 ^ np.uint64(0x51ED270B0A1F3C65)))
        order = np.argsort(key)
        new = np.concatenate(([True], np.diff(key[order]) != 0))
        group = np.empty(len(key), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        h1, h2 = g1[order[new]], g2[order[new]]
        del g1, g2, key, order
        c = np.bincount(group, times * train, len(h1)).astype(np.int64)
        context, own = np.unique(h1, return_inverse=True)
        place = uni.find(context)
        spread = (context == START) | np.where(place >= 0, uni.top[place] if n_hot else False, False)
        total = np.bincount(own, c, len(context)).astype(np.int64)
        total[spread] = np.where(context == START, uni.ends, uni.hot_counts[place] if n_hot else 0)[spread]
        at2 = uni.find(h2)
        c2 = np.where(at2 >= 0, uni.hot_counts[at2] if n_hot else 0, 0)
        c2[h2 == END] = uni.ends
        sure2, seen = (at2 >= 0) | (h2 == END), c > 0
        p2 = uni.probability(c2)
        score = np.where(
            seen, np.where(c > CLEAR, np.log10(np.maximum(c - LARGE, 1)), 0), np.where(sure2, np.log10(p2), 0)
        )
        # contexts known to the packer were divided by already, also where the pair was not seen
        divided = (context == START) | (place >= 0)
        score += np.where(divided[own], ~seen, -1.0 * seen) * np.log10(np.maximum(total[own], 1))
        # documents: occurrences by small count, the rest of the score, and what the base needs of rarer words
        docs, back = np.unique(where, return_inverse=True)
        small = (c > 0) & (c <= CLEAR)
        at = np.flatnonzero(small[group])
        m, back_m = np.unique(where[at] * 8 + c[group[at]], return_inverse=True)
        part = {"m": m, "m_times": np.bincount(back_m, times[at], len(m)), "s": np.bincount(back, times * score[group], len(docs))}
        rarer = (place < 0) & (context != START)
        part["base"] = np.bincount(back, times * np.where(rarer, uni.base(total), 0)[own][group], len(docs))
        part["known"] = np.bincount(back, times * (rarer & (total > 0))[own][group], len(docs))
        open_ = ~seen[group]
        rid = (runs[where // DOCS] << 16) + where % DOCS
        # unseen pairs: their contexts' weights and rarer words are looked up
        ask = open_ & (total[own][group] > 0)
        word = open_ & ~sure2[group]
        needed = spread.copy()
        needed[own[group[ask]]] = True
        q = np.stack([np.bincount(own, (c == r), len(context)) for r in range(1, CLEAR + 1)] + [np.bincount(own, c > CLEAR, len(context))], axis=1)
        den = np.bincount(own, np.where(seen & sure2, p2, 0), len(context))
        follow = seen & ~sure2 & needed[own]
        keep = np.flatnonzero(needed & (total > 0))
        counts = np.array([(c == r).sum() for r in range(1, CLEAR + 2)])
        return {
            "docs": docs, "part": part, "alpha": (rid[ask], h1[group[ask]], times[ask]), "word": (rid[word], h2[group[word]], times[word]),
            "context": (context[keep], total[keep], q[keep], den[keep]), "follow": (h1[follow], h2[follow]), "counts": counts,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, blobs, kinds = [], [], [pa.int64()]

        def rows(size: int, /, **columns) -> pa.RecordBatch:
            types = {
                "kind": pa.int32(), "run": pa.int64(), "place": pa.int32(), "doc_id": kinds[0], "held": pa.bool_(), "n_tokens": pa.int64(),
                "known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "blob": pa.binary(), "rid": pa.int64(), "h1": pa.int64(), "h2": pa.int64(),
                "n": pa.int64(), "q": pa.list_(pa.int64()), "den": pa.float64(),
            }
            arrays = []
            for name, t in types.items():
                v = columns.get(name)
                if v is None:
                    v = pa.nulls(size, t)
                elif isinstance(v, np.ndarray):
                    v = pa.array(v.view(np.int64) if v.dtype == np.uint64 else v, t)
                arrays.append(v if isinstance(v, pa.Array) else pa.array(v, t))
            return pa.RecordBatch.from_arrays(arrays, list(types))

        for batch in batches:
            kinds[0] = batch.column("doc_id").type
            place = batch.column("place").to_numpy()
            docs = batch.filter(pa.array(place >= 0))
            if len(docs):
                names = ("run", "place", "doc_id", "held", "n_tokens", "known", "base", "score")
                yield rows(len(docs), kind=np.full(len(docs), _DOC), **{n: docs.column(n) for n in names})
            for i in np.flatnonzero(place < 0).tolist():
                runs.append(batch.column("run")[i].as_py())
                blobs.append(batch.column("blob")[i].as_py())
        if not blobs:
            return
        got = count(np.array(runs, dtype=np.int64), blobs)
        p, packed = got["part"], []
        few = np.flatnonzero((p["base"] != 0) | (p["known"] > 0))
        some = np.flatnonzero(p["s"])
        cuts = np.arange(len(blobs) + 1) * DOCS
        cuts_m, cuts_s, cuts_b = np.searchsorted(p["m"], cuts * 8), np.searchsorted(got["docs"][some], cuts), np.searchsorted(got["docs"][few], cuts)
        for i in range(len(blobs)):
            m, times = p["m"][cuts_m[i] : cuts_m[i + 1]], p["m_times"][cuts_m[i] : cuts_m[i + 1]]
            s_, f = some[cuts_s[i] : cuts_s[i + 1]], few[cuts_b[i] : cuts_b[i + 1]]
            wide = np.uint8 if not len(times) or times.max() < 256 else np.uint32
            parts = (
                np.array([len(m), np.dtype(wide).itemsize, len(s_), len(f)], dtype=np.int64), (m // 8 % DOCS).astype(np.uint16),
                (m % 8).astype(np.uint8), times.astype(wide), (got["docs"][s_] % DOCS).astype(np.uint16), p["s"][s_],
                (got["docs"][f] % DOCS).astype(np.uint16), p["base"][f], p["known"][f].astype(np.uint32),
            )
            packed.append(b"".join(z.tobytes() for z in parts))
        yield rows(len(blobs), kind=np.full(len(blobs), _PART), run=np.array(runs, dtype=np.int64), blob=packed)
        yield rows(1, kind=np.array([_COUNTS]), q=[got["counts"].tolist()])
        h, total, q, den = got["context"]
        for i in range(0, len(h), 100_000):
            some = slice(i, i + 100_000)
            yield rows(len(h[some]), kind=np.full(len(h[some]), _CONTEXT), h1=h[some], n=total[some], q=pa.array(list(q[some]), pa.list_(pa.int64())), den=den[some])
        a, b = got["follow"]
        yield rows(len(a), kind=np.full(len(a), _FOLLOWER), h1=a, h2=b)
        for kind, (rid, h, n) in ((_ALPHA, got["alpha"]), (_WORD, got["word"])):
            order = np.lexsort((h, rid))  # one row per document and word
            rid, h, n = rid[order], h[order], n[order]
            new = np.flatnonzero(np.concatenate(([True], (np.diff(rid) != 0) | (np.diff(h) != 0)))[: len(rid)])
            n = np.add.reduceat(n, new) if len(new) else n
            yield rows(len(new), kind=np.full(len(new), kind), rid=rid[new], h1=h[new], n=n)

    return run


def _merger(star: np.ndarray):
    """Joins the parts of each run with its documents."""

    def parts(blob: bytes):
        m, wide, n, few = np.frombuffer(blob, np.int64, 4)
        at, out, narrow = 32, [], np.uint8 if wide == 1 else np.uint32
        for kind, size in (
            (np.uint16, m), (np.uint8, m), (narrow, m), (np.uint16, n), (np.float64, n), (np.uint16, few), (np.float64, few), (np.uint32, few),
        ):
            out.append(np.frombuffer(blob, kind, size, at))
            at += size * np.dtype(kind).itemsize
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.concatenate(([0.0], np.log10(star)))
        now, sums, docs = None, [], []

        def flush():
            s, base, known = sums
            for d in docs:
                at = d.column("place").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((np.int64(now) << 16) + at), d.column("doc_id"), d.column("held"), d.column("n_tokens"),
                        pa.array(d.column("known").to_numpy() + known[at]), pa.array(d.column("base").to_numpy() + base[at]),
                        pa.array(d.column("score").to_numpy() + s[at]),
                    ],
                    ["rid", "doc_id", "held", "n_tokens", "n_known", "base_score", "score"],
                )

        for batch in batches:
            kind, runs = batch.column("kind").to_numpy(), batch.column("run").to_numpy()
            # rows of a run are neighbours: its sums go when the next one begins
            edges = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1], [True]))) if len(runs) else []
            for low, high in zip(edges[:-1], edges[1:]):
                if now != runs[low]:
                    if now is not None:
                        yield from flush()
                    now, sums, docs = int(runs[low]), [np.zeros(DOCS), np.zeros(DOCS), np.zeros(DOCS, np.int64)], []
                for i in (low + np.flatnonzero(kind[low:high] == _PART)).tolist():
                    doc, c, times, some, s, few, base, known = parts(batch.column("blob")[i].as_py())
                    sums[0] += np.bincount(doc, times * logs[c], DOCS) if len(doc) else 0
                    sums[0] += np.bincount(some, s, DOCS) if len(some) else 0
                    np.add.at(sums[1], few, base)
                    np.add.at(sums[2], few, known.astype(np.int64))
                mine = batch.slice(low, high - low)
                mine = mine.filter(pa.array(kind[low:high] == _DOC))
                if len(mine):
                    docs.append(mine)
        if now is not None:
            yield from flush()

    return run


def scores(docs: DataFrame, hot: int = HOT, top: int = TOP, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every whole text.

    Learns from the rows whose crc32(doc_id) mod 10 is not 0.  Tokens are words with A-Z lowered and one end; a text's first
    context is its start.  A word seen after its context has its discounted count there, over the context's; any other
    has the context's left mass times the word's own probability, itself discounted, with one class for all unknown words.
    Both levels sum to 1 exactly.  Words are told apart by 64-bit hashes.

    1. Words are counted; the ``hot`` most frequent, their bound, are known to every task.
    2. Each task packs its texts' pairs into arrays by bucket: pairs of one context meet in one bucket, but for
       the ``top`` contexts, whose pairs are spread over all.
    3. A bucket counts its pairs and scores all their occurrences at once.  It passes on sums per document,
       count statistics, and, where a pair was not seen, the context and the rarer word for a join with the tables of
       context weights and of words; so what travels follows the input, and no table is held whole anywhere.

    Null and empty texts have the end alone; rows without an id teach and are scored; repeated rows count each; extra columns
    are ignored; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out("doc_id", 10, 0).alias("held"))
    words = word_counts(rows)
    uni = unigrams(words, hot, top)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(least, 1 << 15), ceil(uni.total / bucket))
    packed = rows.mapInArrow(_packer(uni, buckets), _IN.format(kind=kind)).repartitionById(buckets, F.col("bucket"))
    counted = stored(packed.mapInArrow(_counter(uni), _OUT.format(kind=kind)), "counted")
    n = counted.where(F.col("kind") == _COUNTS).agg(*[F.coalesce(F.sum(F.col("q")[i]), F.lit(0)) for i in range(CLEAR + 1)]).first()
    star = discounted(np.array(n))

    contexts = counted.where(F.col("kind") == _CONTEXT).groupBy("h1").agg(
        F.max("n").alias("n"), F.sum("den").alias("den"), *[F.sum(F.col("q")[i]).alias(f"q{i}") for i in range(CLEAR + 1)]
    )
    followers = counted.where(F.col("kind") == _FOLLOWER).select("h1", F.col("h2").alias("h"))
    more = followers.join(words, "h", "left").groupBy("h1").agg(F.sum(uni.probability_column(F.col("c"))).alias("more"))
    left = F.col(f"q{CLEAR}") * LARGE
    for i, s in enumerate(star.tolist()):
        left = left + F.col(f"q{i}") * (i + 1 - s)
    rest = F.greatest(1 - F.col("den") - F.coalesce("more", F.lit(0.0)), F.lit(uni.unknown))
    alpha = contexts.join(more, "h1", "left").select("h1", F.log10(left / F.col("n") / rest).alias("log"))
    asked = counted.where(F.col("kind") == _ALPHA).select("rid", "h1", "n").join(alpha, "h1")
    rare = counted.where(F.col("kind") == _WORD).select("rid", F.col("h1").alias("h"), "n").join(words, "h", "left")
    extra = asked.select("rid", (F.col("n") * F.col("log")).alias("x")).union(
        rare.select("rid", F.col("n") * F.log10(uni.probability_column(F.col("c"))))
    )
    extra = extra.groupBy("rid").agg(F.sum("x").alias("x"))
    parts = counted.where(F.col("kind").isin(_DOC, _PART)).select("kind", "run", "place", "doc_id", "held", "n_tokens", "known", "base", "score", "blob")
    merged = parts.repartition("run").sortWithinPartitions("run").mapInArrow(
        _merger(star), f"rid long, doc_id {kind}, held boolean, n_tokens long, n_known long, base_score double, score double"
    )
    out = merged.join(extra, "rid", "left")
    return out.select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(uni.total).cast("long").alias("train_tokens"), "base_score",
        (F.col("score") + F.coalesce("x", F.lit(0.0))).alias("score"),
    )
