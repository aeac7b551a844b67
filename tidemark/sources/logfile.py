"""Server CSV logs and tab-separated loads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.streaming.logs import plain_level

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS z"
SESSION_FORMAT = "yyyy-MM-dd HH:mm:ss z"
INSTANCE_FOLDER = r"instid=(\d+)"


def raw_schema() -> T.StructType:
    """The 26 log fields in file order, as text."""
    return T.StructType([T.StructField(n, T.StringType()) for n in schemas.struct("log").names if n != "instid"])


def _options() -> dict[str, str]:
    # Records span lines inside quotes; a record with a wrong field count is dropped.
    return {
        "multiLine": "true", "quote": '"', "escape": '"', "mode": "DROPMALFORMED", "columnPruning": "false",
        "enforceSchema": "true",
    }


def read_csvlog(spark: SparkSession, path: str, instid: int | None = None) -> DataFrame:
    """Typed log records of finished files (one task per file: multi-line files do not split)."""
    return typed(spark.read.schema(raw_schema()).options(**_options()).csv(path), instid)


def read_large_csvlog(spark: SparkSession, path: str, instid: int | None = None) -> DataFrame:
    """The rows of :func:`read_csvlog`, with one task per piece of a file instead of one per file.

    Whether a line begins a record depends on the quotes before it: an even number.  Each piece counts its lines and the
    parity of its quotes, one row per piece carries parity and the last record's start on, and lines
    of one record meet by its start; records of one line (most) are not shuffled.  Spark parses the
    fields of whole records.  Line breaks are ``\\n``.  A piece is what Spark's text reader cuts (``spark.sql.files.maxPartitionBytes``).

    The pieces are read twice.  Should Spark cut them differently the second time (dynamic allocation without
    ``spark.sql.files.minPartitionNum``), the job fails instead of returning other records.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select("_metadata.file_path", F.col("_metadata.file_block_start").alias("piece"), "value")
    lines = raw.mapInArrow(_quote_parity, "file_path string, piece long, line long, odd boolean, whole boolean, value string")
    even_start, odd_start = F.when(~F.col("odd"), F.col("line")), F.when(F.col("odd"), F.col("line"))
    pieces = lines.groupBy("file_path", "piece").agg(
        F.max("line").alias("last"),
        F.max(even_start).alias("even_start"),
        F.max(odd_start).alias("odd_start"),
        F.max_by(F.col("odd") == F.col("whole"), "line").alias("flips"),
    )
    # one row per piece of a file
    earlier = Window.partitionBy("file_path").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("inside", F.coalesce(F.sum(F.col("flips").cast("long")).over(earlier), F.lit(0)) % 2 == 1)
    start = F.when(F.col("inside"), F.col("odd_start")).otherwise(F.col("even_start"))
    pieces = pieces.withColumn("start", F.when(start.isNotNull(), F.struct("piece", start.alias("line"))))
    pieces = pieces.withColumn("open", F.last("start", True).over(earlier)).select("file_path", "piece", "last", "inside", "open")
    known = lines.join(pieces, ["file_path", "piece"], "left")
    cut_alike = F.col("line") <= F.col("last")
    begins = F.when(cut_alike, F.col("odd") == F.col("inside")).otherwise(
        F.raise_error(F.lit("log file pieces were cut differently; set spark.sql.files.minPartitionNum"))
    )
    known = known.withColumn("begins", begins.cast("boolean"))
    single = known.where(F.col("begins") & F.col("whole")).select("file_path", F.col("value").alias("record"))
    # lines of longer records: the start is in the piece or carried on
    inside = Window.partitionBy("file_path", "piece").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    parts = known.where(~(F.col("begins") & F.col("whole")))
    own = F.last(F.when(F.col("begins"), F.struct("piece", "line")), True).over(inside)
    parts = parts.withColumn("record", F.coalesce(own, "open"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("piece", "line", "value"))), lambda x: x["value"])
    longer = parts.groupBy("file_path", "record").agg(F.array_join(joined, "\n").alias("text")).select("file_path", F.col("text").alias("record"))
    records = single.unionByName(longer).where("record <> ''")
    schema = raw_schema().add("_malformed", T.StringType())
    options = {k: v for k, v in _options().items() if k in ("multiLine", "quote", "escape")}
    options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}
    ddl = ", ".join(f"`{f.name}` string" for f in schema.fields)
    parsed = records.select("file_path", F.from_csv("record", ddl, options).alias("r"))
    return typed(parsed.where("r._malformed IS NULL").select("file_path", "r.*"), instid, F.col("file_path"))


def _quote_parity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number each piece's lines; ``odd``: quotes before the line in its piece, ``whole``: the line's own are even.

    A task reads its pieces one after another and each in the file's order.
    """
    piece, line, odd = None, 0, False
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            here = (batch.column(0)[at].as_py(), batch.column(1)[at].as_py())
            same = pc.and_(pc.equal(batch.column(0), here[0]), pc.equal(batch.column(1), here[1])).to_numpy(zero_copy_only=False)
            differs = np.flatnonzero(~same[at:])
            rows = batch.slice(at, int(differs[0]) if len(differs) else None)
            if here != piece:
                piece, line, odd = here, 0, False
            own = pc.count_substring(rows.column(2), '"').to_numpy(zero_copy_only=False).astype(np.int64) % 2
            upto = (np.cumsum(own) + odd) % 2
            before = np.concatenate(([odd], upto[:-1])).astype(bool)
            number = pa.array(np.arange(line, line + rows.num_rows))
            columns = [rows.column(0), rows.column(1), number, pa.array(before), pa.array(own == 0), rows.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["file_path", "piece", "line", "odd", "whole", "value"])
            line, odd, at = line + rows.num_rows, bool(upto[-1]), at + rows.num_rows


def stream_csvlog(
    spark: SparkSession, path: str, instid: int | None = None, files_per_trigger: int = 100, closed: str = "*.csv"
) -> DataFrame:
    """The same records as a stream; processed files are remembered by the checkpoint.

    Only files that match ``closed`` are taken, each once and whole: a server's log must get such a name when it is
    rotated (``.csv`` here), not while it still grows.
    """
    reader = spark.readStream.schema(raw_schema()).options(**_options()).option("maxFilesPerTrigger", files_per_trigger)
    reader = reader.option("pathGlobFilter", closed)
    return typed(reader.csv(path), instid)


def typed(raw: DataFrame, instid: int | None, file_path: Column | None = None) -> DataFrame:
    """Map text fields to the ``log`` columns; empty text becomes NULL.

    Without an id the instance is taken from an ``instid=<n>`` folder in the path.
    """
    if instid is None:
        source = F.col("_metadata.file_path") if file_path is None else file_path
        owner: Column = F.regexp_extract(source, INSTANCE_FOLDER, 1).try_cast("bigint")
    else:
        owner = F.lit(instid).cast("bigint")
    columns = [owner.alias("instid")]
    for field in schemas.struct("log").fields[1:]:
        value = F.nullif(F.col(field.name), F.lit(""))
        if field.name == "elevel":
            value = plain_level(value)
        elif field.name == "timestamp":
            value = F.try_to_timestamp(value, F.lit(TIMESTAMP_FORMAT))
        elif field.name == "session_start":
            value = F.try_to_timestamp(value, F.lit(SESSION_FORMAT))
        elif not isinstance(field.dataType, T.StringType):
            value = value.try_cast(field.dataType)
        columns.append(value.alias(field.name))
    return raw.select(*columns)


def bulk_load(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Tab-separated rows of a fact in schema order, ``null`` standing for NULL."""
    reader = spark.read.schema(_loadable(table)).option("sep", "\t").option("nullValue", "null").option("quote", "")
    loaded = reader.csv(path)
    return loaded.select(*[_from_text(loaded, f).alias(f.name) for f in schemas.struct(table).fields])


def _loadable(table: str) -> T.StructType:
    """CSV cannot hold arrays; they arrive as ``{a,b}`` text."""
    return T.StructType(
        [
            T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType)
            for f in schemas.struct(table).fields
        ]
    )


def _from_text(df: DataFrame, field: T.StructField) -> Column:
    if not isinstance(field.dataType, T.ArrayType):
        return F.col(field.name)
    inner = F.regexp_replace(F.col(field.name), r"^\{|\}$", "")
    items = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[, ]"))
    return F.when(F.col(field.name).isNotNull(), items).cast(field.dataType)
