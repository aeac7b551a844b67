"""printf-style message patterns as regular expressions built at plan time."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CONVERSION = re.compile(r"%(?:%|[-+ 0#]*\d*(?:\.\d+)?(?:hh|h|ll|l)?[sduifX])")
_SEPARATOR = "\x1f"


def _group(conversion: str) -> str:
    kind = conversion[-1]
    if kind == "%":
        return "%"
    return {"s": "(.*?)", "f": r"(-?\d+(?:\.\d+)?)", "X": "([0-9A-Fa-f]+)"}.get(kind, r"(-?\d+)")


def to_regex(pattern: str) -> str:
    """Anchored regular expression with one group per conversion."""
    parts, last = [], 0
    for match in _CONVERSION.finditer(pattern):
        parts += [re.escape(pattern[last : match.start()]), _group(match.group())]
        last = match.end()
    parts.append(re.escape(pattern[last:]))
    return r"(?s)\A" + "".join(parts) + r"\z"


def msg_match(text: Column, pattern: str) -> Column:
    return text.rlike(to_regex(pattern))


def _captured(text: Column, regex: str) -> Column:
    """All groups as an array: one replacement writes them between separators."""
    groups = re.compile(regex.replace(r"\z", r"\Z")).groups
    joined = _SEPARATOR.join(f"${i}" for i in range(1, groups + 1))
    return F.split(F.regexp_replace(text, regex, joined), _SEPARATOR, -1)


def msg_capture(text: Column, pattern: str) -> Column:
    """Array of all captures of a matching text, NULL otherwise."""
    regex = to_regex(pattern)
    return F.when(text.rlike(regex), _captured(text, regex))


def matched(df: DataFrame, text: Column, pattern: str, name: str) -> DataFrame:
    """Rows whose text matches, with the captures as column ``name``.

    The match drops rows through a generator instead of a filter: a filter on the
    captures would be pushed below their projection and match the text again for
    every later condition.
    """
    return df.select("*", F.explode(F.array_compact(F.array(msg_capture(text, pattern)))).alias(name))


def line_starting(text: Column, head: str) -> Column:
    """First line that starts with ``head`` (a cheap anchored search), NULL without one."""
    return F.nullif(F.regexp_extract(text, rf"(?m)^({re.escape(head)}.*)$", 1), F.lit(""))


def line_capture(text: Column, pattern: str) -> Column:
    """Captures of the first line that starts like ``pattern``, NULL if none matches.

    The full text is only searched for the line's fixed beginning; the pattern
    itself is matched against that one line.
    """
    return msg_capture(line_starting(text, pattern[: pattern.index("%")]), pattern)


def lines_capture(text: Column, pattern: str) -> Column:
    """Captures of every line that starts like ``pattern``, as an array of arrays."""
    head = re.escape(pattern[: pattern.index("%")])
    lines = F.regexp_extract_all(text, F.lit(rf"(?m)^({head}.*)$"), 1)
    return F.filter(F.transform(lines, lambda line: msg_capture(line, pattern)), lambda c: c.isNotNull())
