"""Time helpers; spans are bigint microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = "yyyy-MM-dd HH:mm"


def minute_label(t: Column) -> Column:
    return F.date_format(t, MINUTE)


def span(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later) - F.unix_micros(earlier)


def to_second(t: Column) -> Column:
    """Timestamp rounded (not truncated) to the nearest second."""
    return F.timestamp_seconds(seconds_rounded(F.unix_micros(t)))


def seconds_rounded(micros: Column) -> Column:
    return F.round(micros.cast("decimal(24,0)") / F.lit(1000000)).cast("bigint")


def second_text(t: Column) -> Column:
    return F.date_format(to_second(t), "yyyy-MM-dd HH:mm:ss")


def interval_label(micros: Column) -> Column:
    """``HH:MM:SS.ffffff`` of a span."""
    seconds = F.floor(micros / F.lit(1000000)).cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d.%06d",
        F.floor(seconds / F.lit(3600)).cast("bigint"),
        F.floor(seconds / F.lit(60)).cast("bigint") % 60,
        seconds % 60,
        micros % 1000000,
    )


def minus_seconds(t: Column, seconds: Column) -> Column:
    micros = F.round(seconds.cast("double").cast("decimal(24,6)") * 1000000).cast("bigint")
    return F.timestamp_micros(F.unix_micros(t) - micros)
