"""URL filters: dated list entries as validity intervals, joined to captures as of their fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPOCH = 30 * 86400  # seconds of one join epoch
EPOCHS = 1024  # about as many epochs are told apart at most; beyond, they are made wider


def host(url: Column) -> Column:
    """Lower-case host of an http(s) URL without user, port and closing dot; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))
    found = F.regexp_replace(found, r"\.+$", "")
    return F.when(found != "", found)


def plain_key(key: Column) -> Column:
    """A list key as hosts and paths are compared: lower case, no scheme, no closing dot of the host, no empty path parts."""
    key = F.regexp_replace(F.lower(F.trim(key)), r"^[a-z][a-z0-9+.\-]*://", "")
    key = F.regexp_replace(F.regexp_replace(key, "/+", "/"), "/$", "")
    key = F.regexp_replace(key, r"^([^/]*?)\.+(/|$)", "$1$2")
    return F.when((key != "") & ~key.startswith("/"), key)


def intervals(entries: DataFrame) -> DataFrame:
    """``key, action, since, until`` from dated ``entries(key, at, action)``: what holds from one entry to the next.

    ``action`` is what the list says of the key from ``at`` on; ``none`` takes it off.  Of entries of one key and
    second the greatest action holds.  ``until`` is null for what still holds.  Keys are taken as ``plain_key`` gives them; those
    without a host, and null keys, times and actions, are ignored; repeated entries change nothing.
    """
    rows = entries.select(plain_key(F.col("key")).alias("key"), "at", "action").where("key IS NOT NULL AND at IS NOT NULL AND action IS NOT NULL")
    rows = rows.groupBy("key", F.col("at").cast("long").alias("at")).agg(F.max("action").alias("action"))
    history = W.partitionBy("key").orderBy("at")
    rows = rows.withColumn("until", F.lead("at").over(history))
    return rows.where("action <> 'none'").select("key", "action", F.col("at").alias("since"), "until")


def occurring_epochs(captures: DataFrame, epoch: int) -> tuple[int, list[int]]:
    """Width and numbers of the epochs in which there are captures; the width grows until they are about ``EPOCHS`` at most."""
    widths = [epoch << (3 * k) for k in range(20) if epoch << (3 * k) < 1 << 62]
    counts = captures.agg(*[F.approx_count_distinct(F.floor(F.col("fetched") / w)) for w in widths]).first()
    width = next((w for w, n in zip(widths, counts, strict=True) if n <= EPOCHS), widths[-1])
    seen = captures.where("fetched IS NOT NULL").select(F.floor(F.col("fetched") / width).alias("e")).distinct()
    return width, sorted(r.e for r in seen.collect())


def matched(captures: DataFrame, entries: DataFrame, epoch: int = EPOCH) -> DataFrame:
    """Verdict on every capture ``(page_id, url, fetched)`` by the entries that held when it was fetched.

    A key is a host, or a host and the beginning of a path (``host/part``); it covers subdomains, and paths that
    continue after a slash.  The longest key that held decides (ties: the smaller key); ``allow`` keeps, anything else
    drops.  Returns ``page_id, url, host, fetched, matched_key, action, since, kept``.

    As-of join: intervals are spread over those epochs they touch in which there are captures, captures carry their own, so a pair meets by an
    equality on key and epoch, and a key's long history is met in parts.  Keys of a capture are at most its host's
    labels times the numbers of path parts that occur in the list; each meets one interval at most, since a key's intervals are
    disjoint.  Captures without host or time match nothing and are kept; repeated rows are judged each; extra
    columns are ignored; empty tables give empty results or no match.
    """
    rows = captures.select(
        "page_id", "url", host(F.col("url").cast("string")).alias("host"), F.col("fetched").cast("long").alias("fetched")
    )
    held = intervals(entries)
    width, seen = occurring_epochs(rows.where("host IS NOT NULL"), epoch)
    met = F.lit(seen) if seen else F.array().cast("array<bigint>")
    first, last = F.floor(F.col("since") / width), F.floor((F.col("until") - 1) / width)
    held = held.withColumn("epoch", F.explode(F.filter(met, lambda e: (e >= first) & (F.col("until").isNull() | (e <= last)))))

    # equal captures are judged once
    once = rows.where("host IS NOT NULL AND fetched IS NOT NULL").select("url", "host", "fetched").distinct()
    path = F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    # no other beginning of a path can be a key
    depths = held.select((F.size(F.split("key", "/")) - 1).alias("n")).distinct().collect()
    depths = F.expr(f"CAST(array({', '.join(str(r.n) for r in sorted(depths))}) AS ARRAY<INT>)")
    starts = F.transform(
        F.filter(depths, lambda i: i <= F.size(parts)), lambda i: F.array_join(F.slice(F.concat(F.array(F.lit("")), F.transform(parts, F.lower)), 1, i + 1), "/")
    )
    keys = F.flatten(F.transform(domains, lambda d: F.transform(starts, lambda s: F.concat(d, s))))
    asked = once.withColumn("epoch", F.floor(F.col("fetched") / width)).withColumn("key", F.explode(F.array_distinct(keys)))
    hits = asked.join(held, ["key", "epoch"]).where("since <= fetched AND (until IS NULL OR fetched < until)")
    best = hits.groupBy("url", "fetched").agg(
        F.min(F.struct((-F.length("key")).alias("n"), F.col("key"), F.col("action"), F.col("since"))).alias("m")
    )
    out = rows.join(best, ["url", "fetched"], "left")
    return out.select(
        "page_id", "url", "host", "fetched", F.col("m.key").alias("matched_key"), F.col("m.action").alias("action"),
        F.col("m.since").alias("since"), F.coalesce(F.col("m.action") == "allow", F.lit(True)).alias("kept"),
    )
