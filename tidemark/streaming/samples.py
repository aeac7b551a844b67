"""Raw samples rolled up into snapshot facts.

Samples carry ``instid`` and ``sampled_at``; a snapshot is a tumbling window over
``sampled_at``.  Every roll-up aggregates map-side on its entity key first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.delta import with_previous, with_previous_in_time

# Agent defaults.
SNAPSHOT_WINDOW = "10 minutes"
LONG_TRANSACTION_SECONDS = 1.0
LONG_TRANSACTIONS_KEPT = 10
IDLE_QUERY = "<IDLE> in transaction"
SECTOR_BYTES = 512
QUERY_LIMIT = 100  # bytes of one query with its terminator
HISTORY_LIMIT = 1000  # bytes of a whole history and its end mark

STATES = ("idle", "idle_in_xact", "waiting", "running")


def window_start(width: str = SNAPSHOT_WINDOW) -> Column:
    return F.window("sampled_at", width)["start"]


def is_client(backend_type: Column, is_sampler: Column) -> Column:
    return (backend_type == "client backend") & ~is_sampler


def classify_backend(wait_event_type: Column, state: Column) -> Column:
    """waiting / idle / idle_in_xact / running; NULL for other states."""
    return (
        F.when(wait_event_type.isin("LWLock", "Lock"), "waiting")
        .when(state == "idle", "idle")
        .when(state == "idle in transaction", "idle_in_xact")
        .when(state == "active", "running")
    )


def clients(backends: DataFrame) -> DataFrame:
    return backends.where(is_client(F.col("backend_type"), F.col("is_sampler")))


def sample_counts() -> list[Column]:
    """Backends of one sample by state."""
    state = classify_backend(F.col("wait_event_type"), F.col("state"))
    return [*[F.count_if(state == s).alias(s) for s in STATES], F.count(F.lit(1)).alias("backends")]


def window_counts() -> list[Column]:
    """Counts of the samples of one window."""
    return [*[F.sum(s).alias(s) for s in STATES], F.max("backends").alias("max_backends")]


def activity_rollup(backends: DataFrame, width: str = SNAPSHOT_WINDOW) -> DataFrame:
    """Summed state counts and the largest number of backends in one sample."""
    per_sample = clients(backends).groupBy(window_start(width).alias("snap_start"), "instid", "sampled_at").agg(*sample_counts())
    return per_sample.groupBy("snap_start", "instid").agg(*window_counts())


def _xact_seconds() -> Column:
    return (F.unix_micros("sampled_at") - F.unix_micros("xact_start")) / F.lit(1e6)


def long_running(backends: DataFrame) -> DataFrame:
    """Backends whose transaction has been open long enough."""
    return backends.where(
        (F.col("backend_type") == "client backend")
        & F.col("xact_start").isNotNull()
        & (_xact_seconds() >= LONG_TRANSACTION_SECONDS)
        & ~F.coalesce(F.col("in_vacuum"), F.lit(False))
    )


def shown_query() -> Column:
    return F.when(F.col("state") == "idle in transaction", F.lit(IDLE_QUERY)).otherwise(F.col("query"))


def long_xact_rollup(
    backends: DataFrame, width: str = SNAPSHOT_WINDOW, keep: int = LONG_TRANSACTIONS_KEPT
) -> DataFrame:
    """Longest transactions per snapshot with their last seen duration and query."""
    last = long_running(backends).groupBy(
        window_start(width).alias("snap_start"), "instid", "client", "pid", F.col("xact_start").alias("start")
    ).agg(F.max_by(_xact_seconds(), "sampled_at").alias("duration"), F.max_by(shown_query(), "sampled_at").alias("query"))
    order = Window.partitionBy("snap_start", "instid").orderBy(F.desc("duration"), "pid", "start")
    return last.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n")


_DISK = {"rd_sectors": "drs", "rd_ticks": "drt", "wr_sectors": "dws", "wr_ticks": "dwt", "rq_ticks": "dit"}


def disk_rollup(disks: DataFrame, width: str = SNAPSHOT_WINDOW) -> DataFrame:
    """Per device and snapshot: peak sectors per second and counter wraps.

    A sample is compared with the device's previous one, also across snapshots.
    """
    steps = with_previous_in_time(disks, ["instid", "device"], ["sampled_at", *_DISK], ["sampled_at"])
    seconds = F.unix_seconds("sampled_at") - F.unix_seconds("prev_sampled_at")

    def peak(counter: str) -> Column:
        moved = F.col(counter) - F.col(f"prev_{counter}")
        rate = F.when((seconds > 0) & (moved >= 0), moved.cast("double") / F.nullif(seconds, F.lit(0)))
        return F.coalesce(F.max(rate), F.lit(0.0))

    return steps.groupBy(window_start(width).alias("snap_start"), "instid", "device").agg(
        peak("rd_sectors").alias("device_rsps_max"),
        peak("wr_sectors").alias("device_wsps_max"),
        *[F.count_if(F.col(c) < F.col(f"prev_{c}")).alias(f"overflow_{short}") for c, short in _DISK.items()],
    )


CPU_COUNTERS = ("cpu_user", "cpu_system", "cpu_idle", "cpu_iowait")


def cpu_overflow(marks: DataFrame) -> DataFrame:
    """Flag counters that are smaller than at the instance's previous snapshot."""
    steps = with_previous(marks, ["instid"], list(CPU_COUNTERS))
    flags = [
        F.coalesce(F.col(c) < F.col(f"prev_{c}"), F.lit(False)).cast("smallint").alias(c.replace("cpu_", "overflow_"))
        for c in CPU_COUNTERS
    ]
    return steps.select(*marks.columns, *flags)


WAIT_KEY = ["instid", "dbid", "userid", "queryid", "backend_type", "event_type", "event"]


def wait_profile(samples: DataFrame, width: str = SNAPSHOT_WINDOW, keep_queries: bool = True) -> DataFrame:
    """Cumulative count of waiting samples per key at the end of each snapshot window.

    Counts are reduced per window first.  The running total is cut by day: each day is summed alone and starts from
    the total of the key's days before, so no window group holds more than a day's windows or one row per day.
    """
    waiting = samples.where(F.col("event").isNotNull())
    if not keep_queries:
        waiting = waiting.withColumn("queryid", F.lit(0).cast("bigint"))
    counted = waiting.groupBy(window_start(width).alias("snap_start"), *WAIT_KEY).agg(F.count(F.lit(1)).alias("count"))
    counted = counted.withColumn("_day", F.unix_date(F.to_date("snap_start")))
    inside = Window.partitionBy(*WAIT_KEY, "_day").orderBy("snap_start").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*WAIT_KEY).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = counted.groupBy(*WAIT_KEY, "_day").agg(F.sum("count").alias("_n"))
    carried = days.select(
        *[F.col(k).alias(f"_{k}") for k in WAIT_KEY],
        F.col("_day").alias("_of"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    same = F.col("_day") == F.col("_of")
    for k in WAIT_KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    running = counted.withColumn("count", F.sum("count").over(inside)).join(carried, same)
    return running.select("snap_start", *WAIT_KEY, (F.col("count") + F.col("_before")).alias("count"))


RUSAGE_KEY = ["instid", "dbid", "userid", "queryid"]
_USAGE = ("reads", "writes", "user_time", "system_time", "minflts", "majflts", "nvcsws", "nivcsws")


def usage_totals() -> list[Column]:
    def total(kind: str, c: str) -> Column:
        value = F.col(c) * SECTOR_BYTES if c in ("reads", "writes") else F.col(c)
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0)).alias(f"{kind}_{c}")

    return [total(k, c) for k in ("plan", "exec") for c in _USAGE]


def rusage_rollup(executions: DataFrame, width: str | None = SNAPSHOT_WINDOW, by_level: bool = True) -> DataFrame:
    """Resource use per query, split into planning and execution; blocks become bytes."""
    when = [] if width is None else [window_start(width).alias("snap_start")]
    level = ["toplevel"] if by_level else []
    return executions.groupBy(*when, *RUSAGE_KEY, *level).agg(*usage_totals())


def _clip(text: Column, limit: Column) -> Column:
    """Longest prefix of at most ``limit`` bytes that ends at a character."""
    cut = F.substring(text.cast("binary"), F.lit(1), limit)
    return F.regexp_replace(F.make_valid_utf8(cut.cast("string")), "\uFFFD+$", "")


# Commands that only steer a transaction.
_COMMANDS = r"(?i)^\s*(begin|start\s+transaction|commit|end|rollback|abort|savepoint|release|prepare\s+transaction)\b"


# What opens a transaction, what ends one, and what a session's history passes over.
_OPENS = r"(?i)^\s*begin\b"
_ENDS = r"(?i)^\s*(commit|end|abort|rollback|prepare\s+transaction)\b"
_PASSED = r"(?i)^\s*(savepoint|release|start\s+transaction|rollback\s+((work|transaction)\s+)?to)\b"
CHUNK_MICROS = 3600 * 1_000_000


def with_transactions(
    statements: DataFrame, session: Sequence[str] = ("instid", "pid"), order: str = "executed_at", width: int = CHUNK_MICROS
) -> DataFrame:
    """Raw statements with the number ``xact`` of their transaction in the session, as :func:`xact_query_history` wants it.

    BEGIN opens a transaction, and so does every other statement outside of one, for itself alone.  An end of a transaction belongs
    to the last one opened (0: none yet).  Savepoint commands and START TRANSACTION neither open nor end
    one and are left out.  NULL times come first, ties in ``order`` follow the text, NULL before empty; a
    column ``xact`` is replaced.

    Sessions are cut into chunks of ``width`` (microseconds of a timestamp, units of a number).  A session runs one
    statement after another, so a chunk is bounded by what one process does in that time however long the session
    lasts.  A chunk counts what it opens for sure and, before its first command, what it opens if the
    session came in outside a transaction; one row per chunk carries state and number on.
    """
    text = F.coalesce(F.col("query"), F.lit(""))
    at = F.col(order)
    if statements.schema[order].dataType.typeName().startswith("timestamp"):
        at = F.unix_micros(at.cast("timestamp"))
    rows = statements.drop("xact").where(~text.rlike(_PASSED))
    columns = rows.columns
    mark = F.when(text.rlike(_OPENS), True).when(text.rlike(_ENDS), False)  # whether a transaction is open afterwards
    rows = rows.withColumn("_chunk", F.floor(at / width)).withColumn("_mark", mark)
    turn = Window.partitionBy(*session, "_chunk").orderBy(F.col(order).asc_nulls_first(), text, F.col("query").asc_nulls_first())
    before, upto = turn.rowsBetween(Window.unboundedPreceding, -1), turn.rowsBetween(Window.unboundedPreceding, 0)
    state = F.last("_mark", True).over(before)
    plain = F.col("_mark").isNull()
    sure = F.coalesce(F.col("_mark"), ~F.col("_state"), F.lit(False))  # BEGIN, or known to be outside
    rows = rows.withColumn("_state", state)
    rows = rows.withColumn("_sure", sure.cast("long")).withColumn("_maybe", (plain & F.col("_state").isNull()).cast("long"))
    last = F.when(~plain, F.struct(F.col(order).isNotNull(), order, text))
    chunks = rows.groupBy(*session, "_chunk").agg(
        F.sum("_sure").alias("n"), F.sum("_maybe").alias("m"), F.max_by("_mark", last).alias("mark")
    )
    earlier = Window.partitionBy(*session).orderBy(F.col("_chunk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_open", F.coalesce(F.last("mark", True).over(earlier), F.lit(False)))
    opened = F.col("n") + F.when(F.col("_open"), 0).otherwise(F.col("m"))
    chunks = chunks.select(
        *[F.col(k).alias(f"_c_{k}") for k in [*session, "_chunk"]],
        "_open",
        F.coalesce(F.sum(opened).over(earlier), F.lit(0)).alias("_before"),
    )
    same = F.lit(True)
    for k in [*session, "_chunk"]:
        same = same & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    rows = rows.withColumn("_n", F.sum("_sure").over(upto)).withColumn("_m", F.sum("_maybe").over(upto))
    number = F.col("_before") + F.col("_n") + F.when(F.col("_open"), 0).otherwise(F.col("_m"))
    return rows.join(chunks, same).select(*columns, number.cast("long").alias("xact"))


def xact_query_history(
    statements: DataFrame,
    keys: Sequence[str] = ("instid", "pid", "xact"),
    order: str = "executed_at",
    history_limit: int = HISTORY_LIMIT,
    query_limit: int = QUERY_LIMIT,
    record_commands: bool = True,
) -> DataFrame:
    """Queries of each transaction in one text of at most ``history_limit`` bytes with its end mark.

    A query that no longer fits is cut at a character and marked ``...``; if not even its first character and the
    mark fit it is passed over, and later ones are still tried.  ``record_commands=False`` leaves transaction
    commands out.  NULL queries count as empty ones; ties in ``order`` follow the text.

    How long a list can get: put queries into classes by (size, up to 8 bytes; bytes of the first character, w).  A
    query of n bytes leaves a trace if the room is n or more, or w + 4 or more.  From n = 8 on the second is the weaker
    (w <= 4), so within a class the room needed is one constant.  Room never grows, so a class that failed once fails
    for good, and each trace takes a byte at least.  Hence only the first ``history_limit`` queries of a class can
    leave a trace; that limit is applied before the shuffle (group limit), and a query is
    carried by no more than its first ``query_limit`` bytes.
    """
    text = F.coalesce(F.col("query"), F.lit(""))
    if not record_commands:
        statements = statements.where(~text.rlike(_COMMANDS))
    size = F.octet_length(text)
    entry = F.struct(
        F.col(order).alias("at"),
        F.when(size <= query_limit, text).otherwise(_clip(text, F.lit(query_limit))).alias("q"),
        F.least(size, F.lit(query_limit + 1)).alias("size"),
    )
    rows = statements.select(*keys, entry.alias("e"), F.least(size, F.lit(8)).alias("_size"),
                             F.octet_length(F.substring(text, 1, 1)).alias("_width"))
    turn = Window.partitionBy(*keys, "_size", "_width").orderBy("e")
    short = rows.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= history_limit)
    listed = short.groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("_all"))

    def append(done: Column, entry: Column) -> Column:
        query = entry["q"]
        room = F.least(F.lit(history_limit - 1) - F.octet_length(done), F.lit(query_limit))
        kept = F.when(room > 4, _clip(query, room - 4)).otherwise(F.lit(""))
        cut = F.when(kept != "", F.concat(kept, F.lit("...;"))).otherwise(F.lit(""))
        whole = F.when(query.endswith(";"), query).otherwise(F.concat(query, F.lit(";")))
        return F.concat(done, F.when(entry["size"] > room, cut).otherwise(whole))

    return listed.select(*keys, F.aggregate("_all", F.lit(""), append).alias("queries"))
