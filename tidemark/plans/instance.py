"""Instance activity: backends, WAL, I/O, background writer, transaction ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clock import minute_label, seconds_rounded, span
from tidemark.functions.numeric import idiv, mean, quotient, round_real, tps, xid_sub
from tidemark.functions.text import lsn_position
from tidemark.operators.delta import endpoint_pair, since_reset, step, with_previous
from tidemark.plans.common import grew, in_scope, scope_length
from tidemark.repository import Repository

STATES = ("idle", "idle_in_xact", "waiting", "running")

# Agent defaults used when a snapshot has no setting or no predecessor.
SNAPSHOT_SECONDS = 600
SAMPLING_SECONDS = 5
SAMPLING_SETTING = "%.sampling_interval"


def _all_states() -> Column:
    return F.col("idle") + F.col("idle_in_xact") + F.col("waiting") + F.col("running")


def proc_ratio(repo: Repository, begin: int, end: int) -> DataFrame:
    sums = in_scope(repo, "activity", begin, end).agg(
        F.sum(_all_states()).alias("total"), *[F.sum(s).alias(s) for s in STATES]
    )
    return sums.select(
        *[
            F.when(F.col("total") == 0, F.lit(0)).otherwise(quotient(F.col(s) * 100, F.col("total")))
            .cast("decimal(10,1)").alias(s)
            for s in STATES
        ]
    )


def proc_tendency(repo: Repository, begin: int, end: int, true_previous: bool = False) -> DataFrame:
    """Mean backends per sample and their shares for each snapshot.

    The interval is measured from snapshot ``begin - 1`` on; ``true_previous``
    takes the instance's real predecessor instead.
    """
    first = begin - 1
    snaps = _with_predecessor(repo, begin, end) if true_previous else repo.timeline(first, end)
    spans = with_previous(snaps, ["instid"], ["time"], scope_length=scope_length(first, end))
    lasted = seconds_rounded(span(F.col("time"), F.col("prev_time")))
    spans = spans.select("snapid", "time", F.coalesce(lasted, F.lit(SNAPSHOT_SECONDS)).alias("lasted"))
    every = (
        repo.ranged("setting", begin, end)
        .where(F.col("name").like(SAMPLING_SETTING))
        .select("snapid", F.col("setting").cast("int").alias("every"))
    )
    marks = (
        repo.ranged("activity", begin, end)
        .where(F.col("idle").isNotNull())
        .join(spans, "snapid")
        .join(every, "snapid", "left")
        .withColumn("samples", idiv(F.col("lasted"), F.coalesce(F.col("every"), F.lit(SAMPLING_SECONDS))))
    )

    def per_sample(state: str) -> Column:
        return F.when(F.col("samples") == 0, F.col(state)).otherwise(idiv(F.col(state), F.col("samples"))).cast("int")

    def portion(state: str) -> Column:
        share = F.when(_all_states() == 0, F.lit(0)).otherwise(quotient(F.col(state) * 100, _all_states()))
        return share.cast("decimal(10,1)")

    columns = [minute_label(F.col("time")).alias("timestamp")]
    for state in STATES:
        columns += [per_sample(state).alias(state), portion(state).alias(f"{state}_per")]
    return marks.orderBy("snapid").select(*columns)


def proc_tendency_with_average(repo: Repository, begin: int, end: int) -> DataFrame:
    """CLI form: percentages as text and a closing ``Average`` row.

    Rows and averages come from one pass: a grouping-set keyed by snapshot label
    would regroup rows, so the average is an aggregate over the same plan.
    """
    rows = proc_tendency(repo, begin, end)
    wide = []
    for state in STATES:
        wide += [
            F.col(state).cast("decimal(10,1)").alias(state),
            F.concat(F.lit("("), F.col(f"{state}_per").cast("string"), F.lit(" %)")).alias(f"{state}_per"),
        ]
    averages = []
    for state in STATES:
        averages += [
            mean(F.col(state), "decimal(10,1)").alias(state),
            mean(F.col(f"{state}_per"), "decimal(10,1)").alias(f"{state}_per"),
        ]
    average = rows.agg(*averages).withColumn("timestamp", F.lit("Average"))
    return rows.select("timestamp", *wide).unionByName(average.select("timestamp", *wide))


def _wal_marks(repo: Repository, begin: int, end: int) -> DataFrame:
    archive = repo.ranged("archive", begin, end).select(
        "snapid", "last_archived_wal", "archived_count", "failed_count"
    )
    marks = (
        in_scope(repo, "xlog", begin, end)
        .join(archive, "snapid", "left")
        .withColumn("position", lsn_position(F.col("location")))
    )
    return with_previous(
        marks,
        ["instid"],
        ["time", "position", "archived_count", "failed_count"],
        scope_length=scope_length(begin, end),
    ).where(F.col("snapid") > begin)


def wal_tendency(repo: Repository, begin: int, end: int) -> DataFrame:
    written = step("position")
    lasted = span(F.col("time"), F.col("prev_time"))
    mebi = F.lit(1048576)
    return _wal_marks(repo, begin, end).orderBy("snapid").select(
        minute_label(F.col("time")).alias("timestamp"),
        "location",
        F.col("xlogfile").alias("walfile"),
        (written.cast("decimal(24,6)") / mebi).cast("decimal(30,3)").alias("write_size"),
        (tps(written, lasted).cast("decimal(24,6)") / mebi).cast("decimal(30,3)").alias("write_size_per_sec"),
        "last_archived_wal",
        step("archived_count").alias("archive_count"),
        step("failed_count").alias("archive_failed"),
    )


def wal_stats(repo: Repository, begin: int, end: int) -> DataFrame:
    return wal_tendency(repo, begin, end).agg(
        F.sum("write_size").cast("decimal(30,3)").alias("write_total"),
        mean(F.col("write_size_per_sec")).alias("write_speed"),
        F.sum("archive_count").alias("archive_total"),
        F.sum("archive_failed").alias("archive_failed"),
        F.max("walfile").alias("last_wal_file"),
        F.max("last_archived_wal").alias("last_archive_file"),
    )


WAL_COUNTERS = (
    "wal_records", "wal_fpi", "wal_bytes", "wal_buffers_full", "wal_write", "wal_sync", "wal_write_time",
    "wal_sync_time",
)


def stat_wal(repo: Repository, begin: int, end: int) -> DataFrame:
    pair = endpoint_pair(
        repo.at("stat_wal", begin, end),
        [],
        begin,
        end,
        [*WAL_COUNTERS, "stats_reset"],
        presence="both",
    )
    reset_e, reset_b = F.col("e_stats_reset"), F.col("b_stats_reset")
    return pair.select(
        *[since_reset(F.col(f"e_{c}"), F.col(f"b_{c}"), reset_e, reset_b).alias(c) for c in WAL_COUNTERS],
        reset_e.alias("stats_reset"),
    )


def stat_wal2(repo: Repository, begin: int, end: int) -> DataFrame:
    counters = list(WAL_COUNTERS[1:])
    steps = with_previous(
        in_scope(repo, "stat_wal", begin, end), ["instid"], counters, scope_length=scope_length(begin, end)
    )
    return steps.orderBy("snapid").select(
        minute_label(F.col("time")).alias("time"), *[step(c).alias(c) for c in counters]
    )


IO_COUNTERS = (
    "reads", "read_time", "writes", "write_time", "writebacks", "writeback_time", "extends", "extend_time",
    "op_bytes", "hits", "evictions", "reuses", "fsyncs", "fsync_time",
)


def stat_io(repo: Repository, begin: int, end: int) -> DataFrame:
    """I/O steps per backend kind; the first snapshot of a kind counts from zero."""
    keys = ["backend_type", "object", "context"]
    counted = [c for c in IO_COUNTERS if c != "op_bytes"]
    steps = with_previous(
        in_scope(repo, "stat_io", begin, end), keys, counted, scope_length=scope_length(begin, end)
    )

    def out(c: str) -> Column:
        if c == "op_bytes":
            return F.col(c)
        moved = step(c, first=F.lit(0))
        return (round_real(moved, "decimal(30,3)") if c.endswith("_time") else moved).alias(c)

    return steps.orderBy("snapid", *keys).select(
        minute_label(F.col("time")).alias("time"), *keys, *[out(c) for c in IO_COUNTERS], "stats_reset"
    )


def _with_predecessor(repo: Repository, begin: int, end: int) -> DataFrame:
    """Snapshots of the scope plus the instance's latest one before it."""
    mine = repo.table("snapshot").where(F.col("instid") == repo.instance_of(end))
    before = mine.where(F.col("snapid") < begin).agg(F.max("snapid")).scalar()
    return mine.where(F.col("snapid").between(F.coalesce(before, F.lit(begin)), F.lit(end)))


def xid_tendency(repo: Repository, begin: int, end: int) -> DataFrame:
    """Transaction ids used per snapshot.

    The first snapshot is compared with its predecessor outside the scope; that
    single row is fetched by id, so older history is never windowed.
    """
    snaps = _with_predecessor(repo, begin, end).select("snapid", "instid", "time", "xid_current")
    steps = with_previous(snaps, ["instid"], ["xid_current"], scope_length=scope_length(begin, end) + 1)
    return (
        steps.where(F.col("snapid") >= begin)
        .orderBy("snapid")
        .select(
            minute_label(F.col("time")).alias("timestamp"),
            xid_sub(F.col("xid_current"), F.col("prev_xid_current")).alias("xid_increase"),
        )
    )


# report column -> counter of the joined marks
_BGWRITER = {
    "bgwriter_write": "buffers_clean",
    "backend_write": "writes",
    "backend_fsync": "fsyncs",
    "bgwriter_stopscan": "maxwritten_clean",
    "buffer_alloc": "buffers_alloc",
}


def bgwriter_tendency(repo: Repository, begin: int, end: int) -> DataFrame:
    backend = (
        repo.ranged("stat_io", begin, end)
        .where("backend_type = 'client backend' AND object = 'relation' AND context = 'normal'")
        .select("snapid", "writes", "fsyncs")
    )
    marks = in_scope(repo, "bgwriter", begin, end).join(backend, "snapid")
    steps = with_previous(
        marks, ["instid"], ["time", *_BGWRITER.values()], scope_length=scope_length(begin, end)
    ).where(F.col("snapid") > begin)
    lasted = span(F.col("time"), F.col("prev_time"))
    return steps.orderBy("snapid").select(
        minute_label(F.col("time")).alias("timestamp"),
        *[tps(step(c), lasted).alias(f"{out}_tps") for out, c in _BGWRITER.items()],
    )


def bgwriter_stats(repo: Repository, begin: int, end: int) -> DataFrame:
    rates = []
    for out in _BGWRITER:
        rates.append(mean(F.col(f"{out}_tps")).alias(f"{out}_avg"))
        if out not in ("bgwriter_stopscan", "buffer_alloc"):
            rates.append(F.max(f"{out}_tps").cast("decimal(30,3)").alias(f"{out}_max"))
    return bgwriter_tendency(repo, begin, end).agg(*rates)


def ht_info(repo: Repository, begin: int, end: int) -> DataFrame:
    sources = ("statements", "wait_sampling", "rusage")
    pair = endpoint_pair(
        repo.at("ht_info", begin, end),
        [],
        begin,
        end,
        [f"{s}_dealloc" for s in sources],
        at_end=[f"{s}_reset" for s in sources],
        presence="both",
    )
    columns = []
    for s in sources:
        columns += [grew(f"{s}_dealloc").alias(f"{s}_dealloc"), F.col(f"e_{s}_reset").alias(f"{s}_reset")]
    return pair.select(*columns)
