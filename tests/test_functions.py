"""Edge cases of the column library."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import clock, numeric, text


def ev(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def dec(v):
    return F.lit(None if v is None else Decimal(str(v)))


@pytest.mark.parametrize(
    "n, micros, want",
    [(66970, 180_000_000, "372.056"), (5, 0, "0.000"), (5, -1, "0.000"), (None, 10, None), (1, None, None), (1, 2_000_000_000, "0.001")],
)
def test_tps(spark, n, micros, want):
    got = ev(spark, numeric.tps(F.lit(n).cast("bigint"), F.lit(micros).cast("bigint")))
    assert got == (None if want is None else Decimal(want))


@pytest.mark.parametrize(
    "a, b, want", [(4, 5330, "0.001"), (0, 0, "0"), (1, 0, "0"), (1, -5, "0"), (None, 1, None), (2, 3, "0.667"), (-2, 3, "-0.667")]
)
def test_div(spark, a, b, want):
    got = ev(spark, numeric.div(F.lit(a).cast("bigint"), F.lit(b).cast("bigint")))
    assert got == (None if want is None else Decimal(want))


def test_two_step_percent(spark):
    assert ev(spark, numeric.percent(F.lit(4), F.lit(5330))) == Decimal("0.1")


def test_sub_and_np_sub(spark):
    null = F.lit(None).cast("bigint")
    assert ev(spark, numeric.sub(F.lit(3), null)) == 3
    assert ev(spark, numeric.np_sub(F.lit(3), F.lit(10))) == 3
    assert ev(spark, numeric.np_sub(F.lit(13), F.lit(10))) == 3
    assert ev(spark, numeric.np_sub(null, null)) == 0


@pytest.mark.parametrize(
    "size, want",
    [
        (10239, "10239 bytes"), (10240, "10 KiB"), (10 * 1024 * 1024 - 513, "10239 KiB"), (10 * 1024 * 1024 - 1, "10 MiB"), (10 * 1024 * 1024, "10 MiB"),
        (27366520, "26 MiB"), (11 * 1024**3, "11 GiB"), (11 * 1024**4, "11 TiB"), (0, "0 bytes"),
    ],
)
def test_size_pretty(spark, size, want):
    assert ev(spark, numeric.size_pretty(F.lit(size))) == want


def test_size_nearest(spark):
    assert ev(spark, numeric.size_pretty_nearest(F.lit(10 * 1024 + 512))) == "11 KiB"
    assert ev(spark, numeric.size_pretty_system(F.lit(16 * 1024**3))) == "16 GB"


def test_integer_division_truncates(spark):
    assert ev(spark, numeric.idiv(F.lit(-7), 2)) == -3
    assert ev(spark, numeric.mib(F.lit(-1048577))) == -1
    assert ev(spark, numeric.align8(F.lit(85 + 12))) == 104


def test_lsn(spark):
    assert ev(spark, text.lsn_diff(F.lit("1/0"), F.lit("0/FFFFFFFF"))) == 1
    assert ev(spark, text.lsn_part(F.lit("0/685E818 (000000010000000000000006)"))) == "0/685E818"
    assert ev(spark, text.hex_to_long(F.lit("FF"))) == 255


def test_fillfactor(spark):
    stated = F.array(F.lit("a=b"), F.lit("fillfactor=80"))
    assert ev(spark, text.fillfactor(stated)) == 80
    assert ev(spark, text.fillfactor(F.lit(None).cast("array<string>"), 405)) == 70
    assert ev(spark, text.fillfactor(F.array(F.lit("a=b")), 1)) is None


def test_time(spark):
    t = F.lit(datetime(2024, 1, 1, 0, 0, 1, 500000))
    assert ev(spark, clock.to_second(t)) == datetime(2024, 1, 1, 0, 0, 2)
    assert ev(spark, clock.interval_label(F.lit(3_723_000_004))) == "01:02:03.000004"
    assert ev(spark, clock.minus_seconds(t, F.lit(1.25))) == datetime(2024, 1, 1, 0, 0, 0, 250000)
