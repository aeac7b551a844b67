"""Registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import katz, langid, mixing, packing, pii, pivots, quality, recompression, repair, secrets, simhash, toxicity, urllist
from tidemark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


@query("op1_pivot_permutation_index")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


# A bucket is named here by the smallest value in it: the seven leading bits, the rest zero.
_OP2_SQL = r'''
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
cut AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
               list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
win AS (SELECT rid, i, words[i] || chr(32) || words[i + 1] || chr(32) || words[i + 2] AS w
        FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM cut)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM win) WHERE c > 1),
cover AS (SELECT rid, CAST(sum(least(3, coalesce(n - i, 3))) AS BIGINT) AS n
          FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS n FROM twice) GROUP BY rid),
base AS (SELECT c.rid, doc_id, coalesce('=' || lang, '-') AS lk, coalesce('=' || source, '-') AS sk, CAST(len(words) AS BIGINT) AS n_words,
                CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                coalesce(v.n, 0) AS n_repeat_words
         FROM cut c LEFT JOIN cover v ON c.rid = v.rid),
counts AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
rules(metric, hi, lo, spread) AS (VALUES ('word_length', 0.9, 0.1, 5), ('symbols', 0.9, NULL, 5), ('dup_lines', 0.99, NULL, 3), ('repeats', 0.99, NULL, 3)),
rates AS (SELECT rid, lk, sk, 'word_length' AS metric, word_chars * 100 // n_words AS v FROM counts WHERE NOT base_failed
          UNION ALL SELECT rid, lk, sk, 'symbols', greatest(n_symbols - 3, 0) * 1000 // word_chars FROM counts WHERE NOT base_failed
          UNION ALL SELECT rid, lk, sk, 'dup_lines', n_dup_lines * 1000 // n_words FROM counts WHERE NOT base_failed
          UNION ALL SELECT rid, lk, sk, 'repeats', n_repeat_words * 1000 // n_words FROM counts WHERE NOT base_failed),
rounded AS (SELECT lk, sk, metric, v - v % (CAST(1 AS BIGINT) << greatest(CAST(floor(log2(greatest(v, 1))) AS INTEGER) - 6, 0)) AS v FROM rates),
spread_out AS (SELECT 2 AS level, lk AS of_l, sk AS of_s, metric, v FROM rounded
               UNION ALL SELECT 1, lk, '*', metric, v FROM rounded UNION ALL SELECT 0, '*', '*', metric, v FROM rounded),
middles AS (SELECT level, of_l, of_s, metric, count(*) AS docs, quantile_disc(v, 0.5) AS q50, quantile_disc(v, [0.1, 0.9, 0.99]) AS q
            FROM spread_out GROUP BY ALL),
edges AS (SELECT m.*, spread, CASE WHEN hi = 0.9 THEN q[2] ELSE q[3] END AS up, CASE WHEN lo IS NOT NULL THEN q[1] END AS down
          FROM middles m JOIN rules USING (metric)),
fences AS (SELECT level, of_l, of_s, metric, docs, up + spread * greatest(up - q50, up >> 6) AS high,
                  coalesce(down - spread * greatest(q50 - down, down >> 6), 0) AS low FROM edges),
sizes AS (SELECT DISTINCT level, of_l, of_s, docs FROM fences),
groups AS (SELECT g.of_l AS lk, g.of_s AS sk, CASE WHEN g.docs >= 100 THEN 2 WHEN l.docs >= 100 THEN 1 ELSE 0 END AS level
           FROM sizes g JOIN sizes l ON g.of_l = l.of_l AND g.level = 2 AND l.level = 1),
judged AS (SELECT r.rid, bool_and(r.v BETWEEN f.low AND f.high) AS fits
           FROM rates r JOIN groups g USING (lk, sk)
           JOIN fences f ON f.level = g.level AND f.metric = r.metric AND f.of_l = CASE WHEN g.level > 0 THEN g.lk ELSE '*' END
                            AND f.of_s = CASE WHEN g.level > 1 THEN g.sk ELSE '*' END
           GROUP BY r.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(j.fits, false) AS kept, CAST(g.level AS BIGINT) AS level
FROM counts c LEFT JOIN groups g USING (lk, sk) LEFT JOIN judged j USING (rid)'''


@query("op2_quality_quantile_sketch", _OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


@query("op4_simhash_bktree")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4, shingle=4, seed=42)


@query("op5_mix_splitting_tree")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "shards")


_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)"
_YEAR, _BASE = 365 * 86400, 1704067200

_OP6_SQL = rf"""
WITH caps AS (SELECT page_id, url, nullif(regexp_replace(lower(regexp_extract(url, '{_HOST}', 1)), '\.+$', ''), '') AS host,
                     list_filter(string_split(regexp_extract(url, '{_PATH}', 1), '/'), lambda p: p <> '') AS parts,
                     {_BASE} + CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 7) AS BIGINT) % {_YEAR} AS fetched FROM pages),
named AS (SELECT DISTINCT host AS key, 4 AS n FROM caps WHERE host IS NOT NULL
          UNION SELECT DISTINCT regexp_replace(host, '^[^.]*\.', ''), 2 FROM caps WHERE host LIKE '%.%.%'
          UNION SELECT DISTINCT host || '/' || lower(parts[1]), 3 FROM caps WHERE host IS NOT NULL AND len(parts) > 0
          UNION SELECT DISTINCT host || '/' || lower(array_to_string(parts, '/')), 2 FROM caps WHERE host IS NOT NULL AND len(parts) > 2),
entries AS (SELECT key, {_BASE} + CAST('0x' || substr(md5(key || '#' || k), 1, 7) AS BIGINT) % {_YEAR} AS day,
                   ['block', 'none', 'allow', 'none', 'block'][1 + CAST('0x' || substr(md5(key || '!' || k), 1, 7) AS BIGINT) % 5] AS action
            FROM (SELECT key, unnest(range(n)) AS k FROM named)),
held AS (SELECT key, day AS since, lead(day) OVER (PARTITION BY key ORDER BY day) AS until, action
         FROM (SELECT key, day, max(action) AS action FROM entries GROUP BY key, day)),
labels AS (SELECT *, string_split(host, '.') AS names FROM caps WHERE host IS NOT NULL),
doms AS (SELECT page_id, fetched, parts, array_to_string(names[i:], '.') AS dom
         FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM labels)),
asked AS (SELECT DISTINCT page_id, fetched, dom || CASE WHEN j = 0 THEN '' ELSE '/' || lower(array_to_string(parts[:j], '/')) END AS key
          FROM (SELECT *, unnest(range(0, len(parts) + 1)) AS j FROM doms)),
hits AS (SELECT a.page_id, a.key, h.action, h.since, row_number() OVER (PARTITION BY a.page_id ORDER BY length(a.key) DESC, a.key) AS r
         FROM asked a JOIN held h ON a.key = h.key AND h.since <= a.fetched AND (h.until IS NULL OR a.fetched < h.until)
         WHERE h.action <> 'none')
SELECT c.page_id, c.url, c.host, c.fetched, h.key AS matched_key, h.action, h.since, coalesce(h.action = 'allow', true) AS kept
FROM caps c LEFT JOIN hits h ON c.page_id = h.page_id AND h.r = 1"""


def _captures_and_entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages with a fetch time of their own, and a dated list on their hosts, parent domains, first path parts and deep paths."""
    number = "CAST(conv(substr(md5({0}), 1, 7), 16, 10) AS BIGINT)"
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.expr(f"{_BASE} + {number.format('CAST(page_id AS STRING)')} % {_YEAR}"))
    parts = F.filter(F.split(F.regexp_extract("url", _PATH, 1), "/"), lambda p: p != "")
    hosts = pages.select(urllist.host(F.col("url")).alias("host"), parts.alias("parts")).where("host IS NOT NULL")
    named = (
        hosts.select(F.col("host").alias("key"), F.lit(4).alias("n"))
        .union(hosts.where("host LIKE '%.%.%'").select(F.regexp_replace("host", r"^[^.]*\.", ""), F.lit(2)))
        .union(hosts.where("size(parts) > 0").select(F.concat("host", F.lit("/"), F.lower(F.element_at("parts", 1))), F.lit(3)))
        .union(hosts.where("size(parts) > 2").select(F.concat("host", F.lit("/"), F.lower(F.array_join("parts", "/"))), F.lit(2)))
        .distinct()
    )
    dated = named.select("key", F.explode(F.expr("sequence(0, n - 1)")).alias("k"))
    at, turn = number.format("concat(key, '#', k)"), number.format("concat(key, '!', k)")
    entries = dated.select(
        "key",
        F.expr(f"{_BASE} + {at} % {_YEAR}").alias("at"),
        F.expr(f"element_at(array('block', 'none', 'allow', 'none', 'block'), CAST(1 + {turn} % 5 AS INT))").alias("action"),
    )
    return captures, entries


@query("op6_url_temporal_list", _OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urllist.matched(*_captures_and_entries(spark, sf_dir))


@query("op7_katz_backoff")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(table(spark, sf_dir, "documents"))


@query("op8_language_centroids")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


@query("op9_secrets_forest")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


@query("op10_toxicity_nnpu")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_recompression_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = recompression.with_periods(table(spark, sf_dir, "documents"))
    return recompression.digests(recompression.periodic_runs(docs))


#: Rows after damage, then one step per row: the least (cost, audit) in each state (0 start, 1 system, 2 user, 3 assistant), with up to
#: two insertions before every row and at the end.
_OP12_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT) AS bytes
  FROM conversations),
coded AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
         lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS fault FROM raw),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded),
placed AS (
  SELECT conv_id, turn, role, text, copy, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS final
  FROM damaged),
turns AS (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS wrong,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM placed),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (wrong = 'blank') AS blank, count(*) FILTER (wrong = 'duplicate') AS duplicate,
         count(*) FILTER (wrong = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS done FROM facts
  UNION ALL
  SELECT conv_id, i, state, cost, audit, done FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS place FROM (
      SELECT w.conv_id, t.i, CASE e.edit WHEN 'D' THEN w.state WHEN 'R' THEN CASE w.state WHEN 2 THEN 3 ELSE 2 END
                             ELSE CASE t.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS state,
             w.cost + CASE e.edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN e.edit <> 'D' AND t.wrong = 'truncated' THEN 1 ELSE 0 END AS cost,
             w.audit || e.edit AS audit,
             CASE e.edit WHEN 'D' THEN w.done WHEN 'R' THEN list_append(w.done, CASE w.state WHEN 2 THEN 'assistant:' ELSE 'user:' END || t.text)
             ELSE list_append(w.done, t.role || ':' || t.text) END AS done
      FROM (SELECT conv_id, i, cost + 2 * k AS cost, audit || repeat('I', k) AS audit,
                   CASE WHEN k = 0 THEN state WHEN k = 1 THEN CASE state WHEN 2 THEN 3 ELSE 2 END ELSE CASE state WHEN 2 THEN 2 ELSE 3 END END AS state,
                   CASE WHEN k = 0 THEN done WHEN state = 2 THEN list_concat(done, ['assistant:', 'user:'][:k]) ELSE list_concat(done, ['user:', 'assistant:'][:k]) END AS done
            FROM ways, (VALUES (0), (1), (2)) AS v(k)) AS w
      JOIN turns AS t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1
      CROSS JOIN (VALUES ('K'), ('R'), ('D')) AS e(edit)
      WHERE e.edit = 'D' OR (t.wrong NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR (t.initial = 's' AND w.state = 0)
            OR (t.initial = 'u' AND w.state <> 2) OR (t.initial = 'a' AND w.state = 2)))) AS steps) AS ranked
  WHERE place = 1),
ended AS (
  SELECT w.conv_id, min(struct_pack(cost := w.cost + 2 * k, audit := w.audit || repeat('I', k),
         done := CASE WHEN k = 0 THEN w.done WHEN w.state = 2 THEN list_append(w.done, 'assistant:') ELSE list_concat(w.done, ['user:', 'assistant:']) END)) AS best
  FROM ways AS w JOIN facts AS f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i
  JOIN (VALUES (0, 0), (3, 0), (2, 1), (1, 2)) AS v(state, k) ON v.state = w.state
  GROUP BY w.conv_id)
SELECT c.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate,
       coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost,
       coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.done, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c
LEFT JOIN facts AS f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended AS e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op12_lightest_repair", _OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


@query("op13_semi_markov_pii")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digests(pii.personal_data(docs, pii.train(docs)))
