"""Quality rules with thresholds taken from quantile sketches by language and source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stored

BITS = 6  # leading bits kept of a sketched value: a quantile is at most 1/64 below the value


@dataclass(frozen=True)
class Rule:
    """Fence around a group: its ``at`` per mille quantile and ``spread`` times its distance from the median.

    With ``low`` the opposite quantile fences below in the same way.
    """

    metric: str
    value: str  # SQL over the base counts, a non-negative integer
    at: int = 900
    spread: int = 5
    low: bool = False


GRACE = 3  # symbols that say nothing about a rate: what chance gives a text whose group has none
#: Symbols and odd words mark junk, which may be some percent of a group, so the fences start at the outer tenth;
#: repeats are a long tail of good texts, so theirs start at the last hundredth.
RULES = (
    Rule("word_length", "word_chars * 100 DIV nullif(n_words, 0)", low=True),
    Rule("symbols", f"greatest(n_symbols - {GRACE}, 0) * 1000 DIV nullif(word_chars, 0)"),
    Rule("dup_lines", "n_dup_lines * 1000 DIV nullif(n_words, 0)", 990, 3),
    Rule("repeats", "n_repeat_words * 1000 DIV nullif(n_words, 0)", 990, 3),
)
LEAST = 100  # documents a group needs for thresholds of its own


def base_counts(docs: DataFrame) -> DataFrame:
    """Per document ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of the whole text.

    Three-word windows are compared by a 64-bit hash of their words, inside one document.
    """
    cut = docs.select(
        "doc_id", "lang", "source", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), ""))
    cut = cut.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.expr(r"filter(split(text, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
        # windows as (hash, position), sorted: equal ones become neighbours
        F.expr(
            "array_sort(transform(slice(words, 1, greatest(size(words) - 2, 0)),"
            " (x, i) -> struct(xxhash64(x, words[i + 1], words[i + 2]) AS h, i)))"
        ).alias("windows"),
    )
    cut = cut.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "array_sort(transform(filter(windows, (x, k) ->"
            " (k > 0 AND windows[greatest(k - 1, 0)].h = x.h) OR"
            " (k + 1 < size(windows) AND windows[least(k + 1, size(windows) - 1)].h = x.h)), x -> x.i))"
        ).alias("found"),
    )
    # each found window covers its three words, less those the next one covers as well
    covered = F.expr(
        "aggregate(transform(found, (x, k) -> IF(k + 1 < size(found),"
        " least(3, found[least(k + 1, size(found) - 1)] - x), 3)), 0L, (a, x) -> a + x)"
    )
    return cut.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words")
    )


def bucket(value: str) -> str:
    """SQL of the sketch bucket of a non-negative integer: exact below 64, then its seven leading bits."""
    shift = f"(length(bin({value})) - {BITS + 1})"
    return (
        f"CASE WHEN {value} < {1 << BITS} THEN {value} "
        f"ELSE (CAST({shift} AS BIGINT) + 1) * {1 << BITS} + {value} DIV CAST(pow(2, {shift}) AS BIGINT) - {1 << BITS} END"
    )


def bucket_floor(b: str) -> str:
    """SQL of the smallest value of a bucket."""
    return (
        f"CASE WHEN {b} < {1 << BITS} THEN {b} "
        f"ELSE ({1 << BITS} + {b} % {1 << BITS}) * CAST(pow(2, {b} DIV {1 << BITS} - 1) AS BIGINT) END"
    )


def _keyed(df: DataFrame) -> DataFrame:
    """Language and source as never-null keys, apart from the mark of merged groups."""
    return df.withColumns({f"{c}_key": F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("lang", "source")})


def sketches(counts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Quantile sketches ``(lang_key, source_key, metric, bucket, n)``: log-bucket counts that merge by adding.

    The counts are partial aggregates, so a hot source is reduced before any shuffle.
    """
    rows = _keyed(counts.where("NOT base_failed")).select(
        "lang_key",
        "source_key",
        F.explode(F.array(*[F.struct(F.lit(r.metric).alias("metric"), F.expr(r.value).alias("v")) for r in rules])).alias("m"),
    )
    rows = rows.select("lang_key", "source_key", "m.metric", F.expr(bucket("m.v")).alias("bucket"))
    return rows.groupBy("lang_key", "source_key", "metric", "bucket").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, rules: tuple[Rule, ...] = RULES, least: int = LEAST) -> DataFrame:
    """Fences ``lang_key, source_key, level, <metric>_low, <metric>_high`` of every group in the sketch.

    A group of fewer than ``least`` documents takes those of the merged sketch of its language, and one whose
    language is small as well those of the sketch of all.  The distance of quantile and median counts as a bucket's
    width at least, since the sketch cannot tell less.
    """
    every = F.lit("*")
    by_lang = sketch.groupBy("lang_key", "metric", "bucket").agg(F.sum("n").alias("n"))
    by_all = by_lang.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    merged = sketch.unionByName(by_lang.withColumn("source_key", every)).unionByName(
        by_all.withColumn("lang_key", every).withColumn("source_key", every)
    )
    # a window sees the buckets of one sketch, a few hundred at most
    group = W.partitionBy("lang_key", "source_key", "metric")
    ranked = merged.withColumn("below", F.sum("n").over(group.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)))
    ranked = ranked.withColumn("total", F.sum("n").over(group))
    marks = sorted({500, *(r.at for r in rules), *(1000 - r.at for r in rules if r.low)})
    fences = ranked.groupBy("lang_key", "source_key", "metric").agg(
        F.max("total").alias("docs"),
        *[F.expr(bucket_floor(f"min(CASE WHEN below * 1000 >= total * {m} THEN bucket END)")).alias(f"q{m}") for m in marks],
    )
    ends = []
    for r in rules:
        here, middle = F.col("metric") == r.metric, F.col("q500")

        def end(mark: int, sign: int, r: Rule = r, here: Column = here, middle: Column = middle) -> Column:
            edge = F.col(f"q{mark}")
            reach = F.greatest(F.abs(edge - middle), F.shiftright(edge, BITS)) * r.spread
            return F.max(F.when(here, edge + reach * sign)).cast("long")

        ends.append((end(1000 - r.at, -1) if r.low else F.lit(0).cast("long")).alias(f"{r.metric}_low"))
        ends.append(end(r.at, 1).alias(f"{r.metric}_high"))
    fences = fences.groupBy("lang_key", "source_key").agg(F.max("docs").alias("docs"), *ends)
    named = [f"{r.metric}_{e}" for r in rules for e in ("low", "high")]
    groups = fences.where("source_key <> '*'").select("lang_key", "source_key", "docs")
    langs = fences.where("source_key = '*' AND lang_key <> '*'").select("lang_key", F.col("docs").alias("lang_docs"))
    groups = groups.join(langs, "lang_key").select(
        "lang_key",
        "source_key",
        F.expr(f"CASE WHEN docs >= {least} THEN 2 WHEN lang_docs >= {least} THEN 1 ELSE 0 END").alias("level"),
    )
    groups = groups.withColumn("of_lang", F.expr("IF(level > 0, lang_key, '*')")).withColumn(
        "of_source", F.expr("IF(level > 1, source_key, '*')")
    )
    fences = fences.select(F.col("lang_key").alias("of_lang"), F.col("source_key").alias("of_source"), *named)
    return groups.join(fences, ["of_lang", "of_source"]).select("lang_key", "source_key", "level", *named)


def quality(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: int = LEAST, min_words: int = 50, max_repeat: int = 50
) -> DataFrame:
    """Verdicts ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, level`` by document.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat`` percent of them in repeated
    three-word windows.  The others are sketched by language and source, and a document is kept if each of its
    rates lies within the fences of its group (``level`` 2: its own sketch, 1: its language's, 0: that of all).
    Null and empty texts have no words and fail; null languages and sources are groups of their own; repeated rows count
    each; extra columns are ignored; an empty table gives an empty result.
    """
    counts = base_counts(docs).withColumn(
        "base_failed", F.expr(f"n_words < {min_words} OR 100 * n_repeat_words > {max_repeat} * n_words")
    )
    counts = stored(counts, "counts")
    fences = thresholds(sketches(counts, rules), rules, least)
    joined = _keyed(counts).join(fences, ["lang_key", "source_key"], "left")
    fits = " AND ".join(f"({r.value}) BETWEEN {r.metric}_low AND {r.metric}_high" for r in rules)
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.expr(f"IF(base_failed, false, coalesce({fits}, false))").alias("kept"),
        F.col("level").cast("long").alias("level"),
    )
