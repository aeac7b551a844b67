"""Corpus pipeline: documents to packed training sequences in five stages.

Each stage calls one operator of ``tidemark.llm`` on all that the stage before kept. ``run`` writes every
stage's result to the shared folder and reads it again, so a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, mixing, packing, secrets, simhash
from tidemark.llm.common import held_out, stored, table



def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: documents too far from every known language, or without letters, go."""
    model = langid.train(docs.where(~held_out("doc_id", 4, 2)))
    return langid.kept(docs, model)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates: of every group of near texts the one of smallest id stays; rows without an id stay.

    A group is of texts: if an id carries unrelated texts, each stays unless another id has one near it.
    """
    chosen = stored(simhash.representatives(docs, radius=4, shingle=4, seed=42), "representatives")
    rows = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    ids = stored(chosen.select("doc_id").distinct().join(rows, "doc_id"), "chosen")
    single, several = ids.where("n = 1").select("doc_id"), ids.where("n > 1").select("doc_id")
    # each partition hashes its ids only, so texts are moved once and never sorted, at any size
    parts = [docs.join(single.hint("shuffle_hash"), "doc_id", "left_semi"), docs.where("doc_id IS NULL")]
    if not several.isEmpty():
        # rows that repeat an id are told apart by their fingerprints; of equal ones the row of the smallest hash stays
        again = docs.join(several.hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns)
        again = stored(again.withColumn("_row", F.xxhash64(*docs.columns)), "again")
        prints = simhash.fingerprints(again.select(F.col("_row").alias("doc_id"), "text"), 4, 42)
        prints = prints.withColumnRenamed("doc_id", "_row").distinct()
        wanted = again.select("doc_id", "_row").distinct().join(prints, "_row").join(chosen, ["doc_id", "fp"], "left_semi")
        wanted = wanted.groupBy("doc_id", "fp").agg(F.min("_row").alias("_row")).select("doc_id", "_row")
        parts.append(again.join(wanted, ["doc_id", "_row"], "left_semi").drop("_row").dropDuplicates())
    out = parts[0].select(*docs.columns)
    for more in parts[1:]:
        out = out.unionByName(more.select(*docs.columns))
    return out


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: confirmed secrets are masked in the text, all documents stay; ``n_chars`` follows the text."""
    clean = secrets.redact(docs, secrets.train(docs))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: a document comes as often as the mix takes it, its last copy cut to the words left.

    Copies go to the output shards of their draws and are shuffled inside each by a hash.
    """
    return mixing.taken_rows(mixing.mix(docs), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: where each piece of each document goes, with the sequence's final length."""
    return packing.packed(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Fitted models, XXH64 and seeded draws have no SQL; tests/llm/test_pipeline.py checks the rows against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
