"""Text helpers: WAL positions, storage options, index keys, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default fill factor by access method id (0 is the heap).
FILLFACTOR_DEFAULTS = {0: 100, 403: 90, 405: 70, 783: 90, 2742: 100}


def hex_to_long(c: Column) -> Column:
    return F.conv(c, 16, 10).cast("bigint")


def lsn_position(lsn: Column) -> Column:
    """Byte position of a ``HI/LO`` hexadecimal WAL address."""
    high = F.conv(F.split_part(lsn, F.lit("/"), F.lit(1)), 16, 10).cast("decimal(20,0)")
    low = F.conv(F.split_part(lsn, F.lit("/"), F.lit(2)), 16, 10).cast("decimal(20,0)")
    return (high * F.lit(4294967296) + low).cast("decimal(20,0)")


def lsn_diff(a: Column, b: Column) -> Column:
    return (lsn_position(a) - lsn_position(b)).cast("decimal(20,0)")


def lsn_part(location: Column) -> Column:
    """Address in front of the bracketed WAL file name."""
    return F.split_part(location, F.lit(" "), F.lit(1))


def fillfactor(reloptions: Column, access_method: Column | int = 0) -> Column:
    """Fill factor from the storage options, else the default of the access method."""
    am = F.lit(access_method) if isinstance(access_method, int) else access_method
    stated = F.regexp_extract(F.array_join(reloptions, "/"), r"fillfactor=([0-9]+)", 1)
    default = F.lit(None).cast("int")
    for method, value in FILLFACTOR_DEFAULTS.items():
        default = F.when(am == method, value).otherwise(default)
    return F.coalesce(F.nullif(stated, F.lit("")).cast("int"), default)


INDEX_KEYS = r"(?s).*USING[^\(]+\((.*)\)"


def index_keys(indexdef: Column) -> Column:
    return F.regexp_extract(indexdef, INDEX_KEYS, 1)


def has_index_keys(indexdef: Column) -> Column:
    return indexdef.rlike(INDEX_KEYS)


def host(address: Column) -> Column:
    return F.split_part(address, F.lit("/"), F.lit(1))


def qualified(*parts: Column) -> Column:
    """``db.schema.table``, NULL if a part is missing."""
    glued = []
    for part in parts:
        glued += [F.lit("."), part]
    return F.concat(*glued[1:])


def array_unique(arr: Column) -> Column:
    return F.array_sort(F.array_distinct(arr))


def merged_arrays(arr: Column) -> Column:
    """Aggregate: all distinct elements of the arrays in a group, sorted.

    Only distinct arrays enter the buffer, so its size follows the number of
    different arrays rather than the number of rows.
    """
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(arr))))
