"""Tables, indexes and columns: pre-joined views and the reports on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clock import minute_label
from tidemark.functions.numeric import align8, div, mib, percent, round_real
from tidemark.functions.text import fillfactor, has_index_keys, index_keys
from tidemark.operators.delta import endpoint_pair
from tidemark.operators.ranking import asc, desc, top
from tidemark.plans.common import grew, in_scope, total_grew
from tidemark.repository import Repository

Reader = Callable[[str], DataFrame]

# CLI limits
TOP_DISK_USAGE = 10
TOP_UPDATED = 20
TOP_ACCESSED = 20
TOP_LOW_DENSITY = 10


def _names(read: Reader) -> tuple[DataFrame, DataFrame]:
    database = read("database").select("snapid", "dbid", F.col("name").alias("database"))
    schema = read("schema").select("snapid", "dbid", "nsp", F.col("name").alias("schema"))
    return database, schema


def view_tables(repo: Repository, read: Reader | None = None) -> DataFrame:
    """Tables with database and schema names per snapshot."""
    read = read or repo.table
    database, schema = _names(read)
    table = read("table").drop("date").withColumnRenamed("name", "table")
    return table.join(database, ["snapid", "dbid"]).join(schema, ["snapid", "dbid", "nsp"])


def view_indexes(repo: Repository, read: Reader | None = None) -> DataFrame:
    """Indexes with table, schema and database names per snapshot (all tied by database id)."""
    read = read or repo.table
    database, schema = _names(read)
    owner = read("table").select("snapid", "dbid", "tbl", "nsp", F.col("name").alias("table"))
    index = read("index").drop("date").withColumnRenamed("name", "index")
    return (
        index.join(owner, ["snapid", "dbid", "tbl"])
        .join(schema, ["snapid", "dbid", "nsp"])
        .join(database, ["snapid", "dbid"])
        .drop("nsp")
    )


def _at(repo: Repository, *snapids: int) -> Reader:
    return lambda name: repo.at(name, *snapids)


def _table_growth(
    repo: Repository, begin: int, end: int, counters: Sequence[str], at_end: Sequence[str] = ()
) -> DataFrame:
    """One row per table at ``end`` with counters at both ends and its names."""
    pair = endpoint_pair(
        repo.at("table", begin, end), ["dbid", "nsp", "tbl"], begin, end, counters, at_end=["name", *at_end]
    )
    database, schema = _names(_at(repo, end))
    return (
        pair.withColumnRenamed("e_name", "table")
        .join(database.drop("snapid"), "dbid")
        .join(schema.drop("snapid"), ["dbid", "nsp"])
    )


def _visible(repo: Repository, own: bool = False, toast: bool = False) -> Column:
    return ~F.col("schema").isin(*repo.user_schemas(own, toast))


def _relation_names() -> list[Column]:
    return [F.col("database").alias("datname"), F.col("schema").alias("nspname"), F.col("table").alias("relname")]


def _name_order() -> list[Column]:
    return [asc("database"), asc("schema"), asc("table")]


def disk_usage_table(repo: Repository, begin: int, end: int, limit: int | None = None) -> DataFrame:
    counters = ["size", "heap_blks_read", "idx_blks_read", "toast_blks_read", "tidx_blks_read"]
    tables = _table_growth(repo, begin, end, counters).where(_visible(repo))
    ranked = top(tables, [desc(total_grew(*counters[1:])), *_name_order()], limit)
    return ranked.select(
        *_relation_names(),
        mib(F.col("e_size")).alias("size"),
        grew("heap_blks_read").alias("table_reads"),
        grew("idx_blks_read").alias("index_reads"),
        total_grew("toast_blks_read", "tidx_blks_read").alias("toast_reads"),
    )


def heavily_updated_tables(repo: Repository, begin: int, end: int, limit: int | None = None) -> DataFrame:
    kinds = ["n_tup_ins", "n_tup_upd", "n_tup_del"]
    tables = _table_growth(repo, begin, end, [*kinds, "n_tup_hot_upd"])
    order = [desc(total_grew(*kinds)), *[desc(grew(k)) for k in kinds], *_name_order()]
    return top(tables, order, limit).select(
        *_relation_names(),
        *[grew(k).alias(k) for k in kinds],
        total_grew(*kinds).alias("n_tup_total"),
        percent(grew("n_tup_hot_upd"), grew("n_tup_upd")).alias("hot_upd_rate"),
    )


def heavily_accessed_tables(repo: Repository, begin: int, end: int, limit: int | None = None) -> DataFrame:
    areas = ("heap", "idx", "toast", "tidx")
    hits, reads = [f"{a}_blks_hit" for a in areas], [f"{a}_blks_read" for a in areas]
    tables = _table_growth(repo, begin, end, ["seq_scan", "seq_tup_read", *hits, *reads])
    tables = tables.where(_visible(repo)).where(grew("seq_tup_read") > 0)
    per_scan = div(grew("seq_tup_read"), grew("seq_scan"))
    return top(tables, [desc(per_scan), *_name_order()], limit).select(
        *_relation_names(),
        grew("seq_scan").alias("seq_scan"),
        grew("seq_tup_read").alias("seq_tup_read"),
        per_scan.alias("tup_per_seq"),
        percent(total_grew(*hits), total_grew(*hits, *reads)).alias("blks_hit_rate"),
    )


MIN_PHYSICAL_PAGES = 1000


def low_density_tables(repo: Repository, begin: int, end: int, limit: int | None = None) -> DataFrame:
    """Tables whose rows would fit into far fewer pages than they occupy."""
    all_tables = view_tables(repo, _at(repo, end))
    widths = (
        repo.at("column", end)
        .where(F.col("attnum") > 0)
        .groupBy("dbid", "tbl")
        .agg(align8(F.sum("avg_width")).alias("width"))
    )
    toast = all_tables.select("dbid", F.col("tbl").alias("toastrelid"), F.col("size").alias("toast_size"))
    sizes = F.struct("page_size", "page_header_size", "htup_header_size", "item_id_size")
    mine = repo.table("instance").where(F.col("instid") == repo.instance_of(end))
    tables = (
        all_tables.where((F.col("relkind") == "r") & _visible(repo, own=True, toast=True))
        .join(widths, ["dbid", "tbl"], "left")
        .join(toast, ["dbid", "toastrelid"], "left")
        .withColumn("page", mine.agg(F.max(sizes)).scalar())
        .select("*", "page.*")
    )
    usable = (F.col("page_size") - F.col("page_header_size")) * fillfactor(F.col("reloptions"))
    per_row = (F.col("width") + F.col("htup_header_size") + F.col("item_id_size")) * 100
    rows_per_page = F.floor(div(usable, per_row))
    stored = F.col("size") + F.when(F.col("toastrelid") == 0, F.lit(0)).otherwise(F.col("toast_size"))
    dense = tables.select(
        *_relation_names(),
        "n_live_tup",
        F.ceil(div(F.col("n_live_tup"), rows_per_page)).cast("bigint").alias("logical_pages"),
        div(stored, F.col("page_size")).alias("pages"),
    ).where(F.col("pages") > MIN_PHYSICAL_PAGES)
    dense = dense.select(
        "datname",
        "nspname",
        "relname",
        "n_live_tup",
        "logical_pages",
        F.round("pages").cast("bigint").alias("physical_pages"),
        (F.col("logical_pages").cast("decimal(20,0)") * 100 / F.col("pages").cast("decimal(24,3)"))
        .cast("decimal(30,1)")
        .alias("tratio"),
    )
    return top(dense, [asc("tratio"), asc("datname"), asc("nspname"), asc("relname")], limit)


def correlation(repo: Repository, begin: int, end: int) -> DataFrame:
    column = repo.at("column", end).where(F.col("correlation") < 1).select(
        "dbid", "tbl", "attnum", F.col("name").alias("attname"), "correlation"
    )
    # One row per indexed column turns the array test into an equi-join.
    keyed = (
        view_indexes(repo, _at(repo, end))
        .where(_visible(repo))
        .withColumn("attnum", F.explode(F.array_distinct("indkey")))
    )
    return (
        keyed.join(column, ["dbid", "tbl", "attnum"])
        .orderBy(asc("correlation"), *_name_order(), asc("attname"))
        .select(*_relation_names(), "attname", round_real(F.col("correlation"), "decimal(5,3)").alias("correlation"))
    )


SCHEMA_COUNTERS = ["size", "seq_scan", "idx_scan"]


def schema_columns() -> list[Column]:
    """Figures of one table."""
    return [
        *_relation_names(),
        F.col("attnum"),
        F.col("e_n_live_tup").alias("tuples"),
        mib(F.col("e_size")).alias("size"),
        mib(grew("size")).alias("size_incr"),
        grew("seq_scan").alias("seq_scan"),
        grew("idx_scan").alias("idx_scan"),
    ]


def schema_info_tables(repo: Repository, begin: int, end: int) -> DataFrame:
    tables = _table_growth(repo, begin, end, SCHEMA_COUNTERS, at_end=["n_live_tup"]).where(_visible(repo, own=True))
    columns = repo.at("column", end).groupBy("dbid", "tbl").agg(F.count(F.lit(1)).alias("attnum"))
    return tables.join(columns, ["dbid", "tbl"], "left").orderBy(*_name_order()).select(*schema_columns())


def schema_info_indexes(repo: Repository, begin: int, end: int) -> DataFrame:
    counters = ["size", "idx_scan", "idx_tup_fetch", "idx_blks_read", "idx_blks_hit"]
    pair = endpoint_pair(
        repo.at("index", begin, end), ["dbid", "tbl", "idx"], begin, end, counters, at_end=["name", "indexdef"]
    ).where(has_index_keys(F.col("e_indexdef")))
    database, schema = _names(_at(repo, end))
    owner = repo.at("table", end).select("dbid", "tbl", "nsp", F.col("name").alias("table"))
    return (
        pair.join(owner, ["dbid", "tbl"])
        .join(schema.drop("snapid"), ["dbid", "nsp"])
        .join(database.drop("snapid"), "dbid")
        .where(_visible(repo, own=True))
        .orderBy(asc("database"), asc("schema"), asc("e_name"))
        .select(
            F.col("database").alias("datname"),
            F.col("schema").alias("schemaname"),
            F.col("e_name").alias("indexname"),
            F.col("table").alias("tablename"),
            mib(F.col("e_size")).alias("size"),
            mib(grew("size")).alias("size_incr"),
            grew("idx_scan").alias("scans"),
            div(grew("idx_tup_fetch"), grew("idx_scan")).alias("rows_per_scan"),
            grew("idx_blks_read").alias("blks_read"),
            grew("idx_blks_hit").alias("blks_hit"),
            index_keys(F.col("e_indexdef")).alias("keys"),
        )
    )


def setting_parameters(repo: Repository, begin: int, end: int) -> DataFrame:
    """Settings at either end; a changed one reads ``old -> new``."""
    pair = endpoint_pair(
        repo.at("setting", begin, end), ["name"], begin, end, ["setting", "unit", "source"], presence="any"
    )
    old, new = F.col("b_setting"), F.col("e_setting")
    unset = F.lit("(default)")
    return pair.orderBy("name").select(
        "name",
        F.when(old == new, old)
        .otherwise(F.concat(F.coalesce(old, unset), F.lit(" -> "), F.coalesce(new, unset)))
        .alias("setting"),
        F.coalesce("e_unit", "b_unit").alias("unit"),
        F.coalesce("e_source", "b_source").alias("source"),
    )


# Up to this many chosen tables (three ids each) are a few hundred KiB to broadcast.
BROADCAST_TABLES = 10_000


def modified_row_ratio(repo: Repository, begin: int, end: int, table_num: int) -> DataFrame:
    """Percent of rows changed since the last analyze, for the largest tables."""
    keys = ["dbid", "nsp", "tbl"]
    largest = (
        in_scope(repo, "table", begin, end)
        .groupBy(*keys)
        .agg(F.max("reltuples").alias("rows"))
        .orderBy(desc("rows"), *[asc(k) for k in keys])
        .limit(table_num)
        .select(*keys)
    )
    if table_num <= BROADCAST_TABLES:
        largest = F.broadcast(largest)
    chosen = in_scope(repo, "table", begin, end).join(largest, keys).withColumnRenamed("name", "table")
    database, schema = _names(lambda name: repo.scoped(name, begin, end))
    modified = percent(F.col("n_mod_since_analyze"), F.round("reltuples").cast("bigint"), "decimal(34,3)")
    return (
        chosen.join(database, ["snapid", "dbid"])
        .join(schema, ["snapid", "dbid", "nsp"])
        .groupBy(minute_label(F.col("time")).alias("timestamp"), *_relation_names())
        .agg(F.max(modified).alias("ratio"))
        .orderBy("timestamp", "datname", "nspname", "relname")
    )
