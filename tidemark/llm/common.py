"""Small helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Without one a session of a single process (tests) uses a temporary folder; on a cluster executors would not see
    each other's files there, so it must be named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="llm-"))
    return _LOCAL[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of a column's text modulo ``modulus``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def held_out(column: str, modulus: int, rest: int) -> Column:
    """Whether a row belongs to the held-out fold; a row without an id does not."""
    return F.coalesce(remainder(column, modulus) == rest, F.lit(False))


def n_words(text: Column | str) -> Column:
    """Number of words; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
