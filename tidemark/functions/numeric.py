"""Counter arithmetic on columns: rates, ratios, null-tolerant deltas, size text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wide enough for byte counters times 100 and for millisecond fractions; a
# quotient of two of these keeps 14 fraction digits, far beyond the 3 we round to.
OPERAND = "decimal(24,6)"
RATE = "decimal(30,3)"
WRAP = 4294967296  # 32-bit counter range


def _guard(result: Column, *inputs: Column) -> Column:
    """NULL if any input is NULL."""
    missing = reduce(lambda a, b: a | b, [i.isNull() for i in inputs])
    return F.when(~missing, result)


def quotient(a: Column, b: Column) -> Column:
    """Exact decimal a / b, NULL on a zero divisor."""
    return a.cast(OPERAND) / F.nullif(b.cast(OPERAND), F.lit(0).cast(OPERAND))


def tps(amount: Column, micros: Column) -> Column:
    """Amount per second over ``micros`` microseconds; 0 for an empty or negative span."""
    seconds = micros.cast("decimal(20,0)") / F.lit(1000000)
    rate = F.when(micros > 0, quotient(amount, seconds)).otherwise(F.lit(0))
    return _guard(rate.cast(RATE), amount, micros)


def div(a: Column, b: Column) -> Column:
    """Ratio rounded to three decimals; a divisor that is not positive gives 0."""
    ratio = F.when((a != 0) & (b > 0), quotient(a, b)).otherwise(F.lit(0))
    return _guard(ratio.cast(RATE), a, b)


def percent(a: Column, b: Column, kind: str = "decimal(30,1)") -> Column:
    """Percentage of the already rounded ratio (two-step rounding is intended)."""
    return (div(a, b) * 100).cast(kind)


def sub(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))


def np_sub(a: Column, b: Column) -> Column:
    """Counter step that survives a restart: a drop means the counter began anew."""
    step = sub(a, b)
    return F.when(step >= 0, step).otherwise(F.coalesce(a, F.lit(0)))


def xid_sub(a: Column, b: Column) -> Column:
    return a.cast("decimal(20,0)") - b.cast("decimal(20,0)")


def unwrap(value: Column, wraps: Column) -> Column:
    """Value of a 32-bit counter that passed its range ``wraps`` times since the last mark."""
    return value + wraps.cast("bigint") * F.lit(WRAP)


def idiv(a: Column, b: int | Column) -> Column:
    """Integer division that truncates toward zero."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def mib(bytes_: Column) -> Column:
    """Bytes to whole MiB, truncated toward zero."""
    shifted = F.shiftright(F.abs(bytes_.cast("bigint")), 20)
    return F.when(bytes_ < 0, -shifted).otherwise(shifted)


def mean(c: Column, kind: str = "decimal(30,3)") -> Column:
    """Exact average of an integer or decimal column, rounded once at the end."""
    return quotient(F.sum(c.cast("decimal(24,6)")), F.count(c)).cast(kind)


def mean_real(c: Column, kind: str = "decimal(30,3)") -> Column:
    return F.avg(c.cast("double")).cast("decimal(38,12)").cast(kind)


def round_real(c: Column, kind: str) -> Column:
    """Binary float to decimal(p,s), half away from zero on the shown decimal digits."""
    return c.cast("double").cast("decimal(38,12)").cast(kind)


# Units and the limit below which the finer unit is kept.
SIZE_UNITS = ["KiB", "MiB", "GiB", "TiB"]
SYSTEM_UNITS = ["kB", "MB", "GB", "TB", "PB"]
SIZE_LIMIT = 10 * 1024


def _scaled_text(size: Column, units: list[str], in_unit, fits) -> Column:
    label = F.concat(in_unit(len(units)).cast("string"), F.lit(f" {units[-1]}"))
    for power in range(len(units) - 1, 0, -1):
        text = F.concat(in_unit(power).cast("string"), F.lit(f" {units[power - 1]}"))
        label = F.when(fits(power), text).otherwise(label)
    return F.when(size < SIZE_LIMIT, F.concat(size.cast("string"), F.lit(" bytes"))).otherwise(label)


def size_pretty(size: Column, units: list[str] = SIZE_UNITS) -> Column:
    """Byte count as text; each larger unit is rounded from its half unit."""
    size = size.cast("bigint")

    def halves(power: int) -> Column:
        return F.shiftright(size, 10 * power - 1)

    return _scaled_text(
        size,
        units,
        lambda power: F.shiftright(halves(power) + 1, 1),
        lambda power: halves(power) < 2 * SIZE_LIMIT - 1,
    )


def size_pretty_nearest(size: Column) -> Column:
    """Variant for repository totals: the unit is picked on the exact size, then rounded to nearest."""
    size = size.cast("bigint")

    def nearest(power: int) -> Column:
        return F.shiftright(size, 10 * power) + F.shiftright(size, 10 * power - 1).bitwiseAND(1)

    return _scaled_text(
        size, SIZE_UNITS, nearest, lambda power: size < SIZE_LIMIT * 1024**power
    )


def size_pretty_system(size: Column) -> Column:
    return size_pretty(size, SYSTEM_UNITS)


def align8(c: Column) -> Column:
    return (c + 7).bitwiseAND(F.lit(-8))
