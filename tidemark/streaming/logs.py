"""Log records: levels, filters, text lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# LOG ranks between ERROR and FATAL when a threshold is applied.
LEVELS = ["DEBUG", "INFO", "NOTICE", "WARNING", "ERROR", "LOG", "FATAL", "PANIC", "ALERT", "DISABLE"]
# Order in which level adjustments are tried; the first match wins.
ADJUST_ORDER = ["FATAL", "LOG", "ERROR", "WARNING", "NOTICE", "INFO"]
# Operation requests an agent writes into the log at level LOG: "<agent>: <request>".
CONTROL_REQUEST = r"^\w+: (snapshot requested|maintenance requested|autovacuum cancel request)$"


def level_rank(level: Column) -> Column:
    rank = F.lit(None).cast("int")
    for i, name in enumerate(LEVELS):
        rank = F.when(level == name, i).otherwise(rank)
    return rank


def level_required(level: Column, minimum: str) -> Column:
    return level_rank(level) >= LEVELS.index(minimum.upper())


def plain_level(level: Column) -> Column:
    """DEBUG1..DEBUG5 are one level."""
    return F.when(level.startswith("DEBUG"), F.lit("DEBUG")).otherwise(level)


def adjust_level(level: Column, sqlstate: Column, rules: Mapping[str, Sequence[str]]) -> Column:
    """Level of a record after the SQLSTATE rules (``{new level: [sqlstate, ...]}``)."""
    adjusted = level
    for name in reversed(ADJUST_ORDER):
        states = [s.strip() for s in rules.get(name, ())]
        if states:
            adjusted = F.when(sqlstate.isin(*states), F.lit(name)).otherwise(adjusted)
    return adjusted


def is_control(level: Column, message: Column) -> Column:
    return F.coalesce((level == "LOG") & message.rlike(CONTROL_REQUEST), F.lit(False))


def user_allowed(username: Column, hidden: Sequence[str]) -> Column:
    """False for listed users; records without a user pass."""
    return ~F.coalesce(username.isin(*hidden), F.lit(False)) if hidden else F.lit(True)


@dataclass(frozen=True)
class Route:
    """One destination: its threshold, hidden users and level adjustments."""

    minimum: str
    hidden_users: Sequence[str] = ()
    adjust: Mapping[str, Sequence[str]] = field(default_factory=dict)


def routed(log: DataFrame, route: Route) -> DataFrame:
    """Records that a destination takes, control messages left out."""
    kept = log.where(~is_control(F.col("elevel"), F.col("message")))
    kept = kept.withColumn("elevel", adjust_level(F.col("elevel"), F.col("sqlstate"), route.adjust))
    return kept.where(
        level_required(F.col("elevel"), route.minimum) & user_allowed(F.col("username"), route.hidden_users)
    )


# --- text lines --------------------------------------------------------------
TERSE, DEFAULT, VERBOSE = 0, 1, 2
STAMP = "yyyy-MM-dd HH:mm:ss.SSS z"
STAMP_SECONDS = "yyyy-MM-dd HH:mm:ss z"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _client(with_port: bool) -> Column:
    """Client host, and its port in brackets if asked."""
    address = _text("client_addr")
    split_at = r"^(?!\[)(.*):([^:]*)$"
    shown = F.regexp_replace(address, split_at, "$1($2)" if with_port else "$1")
    return F.when(address.rlike(split_at), shown).otherwise(address)


def _escape(letter: str) -> Column:
    """Value of one prefix escape; unknown letters give nothing."""
    plain = {
        "u": "username", "d": "database", "c": "session_id", "p": "pid", "l": "session_line_num",
        "i": "ps_display", "v": "vxid", "x": "xid", "e": "sqlstate", "b": "backend_type", "P": "leader_pid",
        "Q": "query_id",
    }
    if letter in plain:
        return _text(plain[letter])
    if letter == "a":
        return F.coalesce(F.nullif(F.col("application_name"), F.lit("")), F.lit("[unknown]"))
    if letter in "mt":
        stamp = F.date_format("timestamp", STAMP if letter == "m" else STAMP_SECONDS)
        return F.coalesce(stamp, F.lit(""))
    if letter == "s":
        return F.coalesce(F.date_format("session_start", STAMP_SECONDS), F.lit(""))
    if letter in "rh":
        return _client(with_port=letter == "r")
    return F.lit("%" if letter == "%" else "")


def line_prefix(template: str) -> Column:
    """Prefix template as a concatenation; ``%q`` ends it for records without a user."""
    pieces: list[Column] = []
    i = 0
    while i < len(template):
        if template[i] != "%":
            stop = template.find("%", i)
            stop = len(template) if stop < 0 else stop
            pieces.append(F.lit(template[i:stop]))
            i = stop
            continue
        letter = template[i + 1 : i + 2]
        i += 2
        if letter == "q":
            rest = F.when(_text("username") != "", line_prefix(template[i:])).otherwise(F.lit(""))
            return F.concat(*pieces, rest)
        if letter:
            pieces.append(_escape(letter))
    return F.concat(*pieces) if pieces else F.lit("")


def _tabbed(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("\n\t"))


def format_log_line(prefix: str, verbosity: int = DEFAULT) -> Column:
    """Text of a record: message line and the detail lines its verbosity shows."""
    lead = line_prefix(prefix)
    position = F.coalesce(F.col("user_query_pos"), F.col("query_pos"))
    head = [lead, F.col("elevel"), F.lit(":  ")]
    if verbosity >= VERBOSE:
        head += [_text("sqlstate"), F.lit(": ")]
    message = F.coalesce(F.nullif(F.col("message"), F.lit("")), F.lit("missing error text"))
    head += [
        _tabbed(message),
        F.when(position.isNotNull(), F.concat(F.lit(" at character "), position.cast("string"))).otherwise(F.lit("")),
    ]
    tags: list[tuple[str, str]] = []
    if verbosity >= DEFAULT:
        tags = [("DETAIL", "detail"), ("HINT", "hint"), ("QUERY", "query"), ("CONTEXT", "context")]
    if verbosity >= VERBOSE:
        tags.append(("LOCATION", "location"))
    tags.append(("STATEMENT", "user_query"))
    lines = [
        F.when(_text(c) != "", F.concat(F.lit("\n"), lead, F.lit(f"{tag}:  "), _tabbed(_text(c)))).otherwise(F.lit(""))
        for tag, c in tags
    ]
    return F.concat(*head, *lines)
