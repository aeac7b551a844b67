"""Small SQL builders for exact arithmetic in DuckDB."""

from __future__ import annotations

B, E, INST = 9, 49, 1


def ratio(n: str, d: str, scale: int = 3) -> str:
    """n / d for integers, rounded half away from zero to ``scale`` digits, as DOUBLE."""
    return f"CAST({units(n, d, scale)} AS DOUBLE) / {10**scale}"


def units(n: str, d: str, scale: int = 3) -> str:
    """Same, in integer units of ``10 ** -scale``."""
    top, low = f"CAST({n} AS HUGEINT)", f"CAST({d} AS HUGEINT)"
    return f"(CASE WHEN {top} < 0 THEN -1 ELSE 1 END * ((abs({top}) * {2 * 10**scale} + {low}) // (2 * {low})))"


def tps(n: str, us: str) -> str:
    return f"(CASE WHEN ({n}) IS NULL OR ({us}) IS NULL THEN NULL WHEN ({us}) > 0 THEN {ratio(f'({n}) * 1000000', us)} ELSE 0.0 END)"


def div3(a: str, b: str) -> str:
    """div() in thousandths."""
    return f"(CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN NULL WHEN ({a}) = 0 OR ({b}) <= 0 THEN 0 ELSE {units(a, b)} END)"


def div(a: str, b: str) -> str:
    return f"CAST({div3(a, b)} AS DOUBLE) / 1000"


def pct(a: str, b: str) -> str:
    return f"CAST({div3(a, b)} AS DOUBLE) / 10"


def sub(c: str) -> str:
    return f"(COALESCE(e.{c}, 0) - COALESCE(b.{c}, 0))"


def half(u: str, d: int) -> str:
    """Integer u / d rounded half up (non-negative)."""
    return f"((2 * ({u}) + {d}) // {2 * d})"


def mins(t: str) -> str:
    return f"strftime({t}, '%Y-%m-%d %H:%M')"


def sec(t: str) -> str:
    return f"strftime(make_timestamp(((epoch_us({t}) + 500000) // 1000000) * 1000000), '%Y-%m-%d %H:%M:%S.%f')"


def sec_text(t: str) -> str:
    return f"strftime(make_timestamp(((epoch_us({t}) + 500000) // 1000000) * 1000000), '%Y-%m-%d %H:%M:%S')"


def full(t: str) -> str:
    return f"strftime({t}, '%Y-%m-%d %H:%M:%S.%f')"


def mib(c: str) -> str:
    return f"CAST({c} AS BIGINT) // 1048576"


def big(c: str) -> str:
    return f"CAST({c} AS BIGINT)"


def avg3(c: str, scale: int = 3) -> str:
    """Exact average of an integer column."""
    return f"(CASE WHEN COUNT({c}) > 0 THEN {ratio(f'SUM({c})', f'COUNT({c})', scale)} END)"


def size_text(v: str) -> str:
    """Byte count text with half-unit rounding."""
    h = [f"(({v}) >> {9 + 10 * i})" for i in range(4)]
    return (
        f"(CASE WHEN {v} < 10240 THEN CAST({v} AS VARCHAR) || ' bytes' "
        f"WHEN {h[0]} < 20479 THEN CAST(({h[0]} + 1) // 2 AS VARCHAR) || ' KiB' "
        f"WHEN {h[1]} < 20479 THEN CAST(({h[1]} + 1) // 2 AS VARCHAR) || ' MiB' "
        f"WHEN {h[2]} < 20479 THEN CAST(({h[2]} + 1) // 2 AS VARCHAR) || ' GiB' "
        f"ELSE CAST(({h[3]} + 1) // 2 AS VARCHAR) || ' TiB' END)"
    )


def lsn(text: str) -> str:
    """Byte position of a HI/LO hexadecimal text."""
    part = f"split_part({text}, ' ', 1)"
    high = f"CAST('0x' || split_part({part}, '/', 1) AS BIGINT)"
    low = f"CAST('0x' || split_part({part}, '/', 2) AS BIGINT)"
    return f"({high} * 4294967296 + {low})"
