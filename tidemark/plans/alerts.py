"""Threshold alerts, evaluated for every snapshot of a range at once.

A rule is a callable ``(AlertInput) -> DataFrame`` with the columns of
``RULE_COLUMNS``.  ``RULES`` is the default set in report order; callers may pass
their own.  A snapshot is judged only if the instance has an earlier one and its
thresholds are enabled; a negative threshold switches a rule off.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clock import second_text, seconds_rounded
from tidemark.functions.numeric import div
from tidemark.functions.text import host, lsn_diff, lsn_part
from tidemark.operators.delta import with_previous
from tidemark.plans.relations import view_indexes, view_tables
from tidemark.repository import Repository

# The alert texts below must read as they do in existing reports.
RULE_COLUMNS = ["snapid", "rule", "entity", "value", "threshold", "message"]
MIN_PAGES = 1000  # smaller tables are too small for a garbage ratio


def xact_sums(database: DataFrame) -> DataFrame:
    """What the transaction rules compare between snapshots."""
    sums = [F.sum("xact_rollback").alias("rollbacks"), F.sum("xact_commit").alias("commits")]
    return database.groupBy("snapid").agg(*sums)


def statement_marks(statement: DataFrame) -> DataFrame:
    """What the query rules compare between snapshots; texts are matched by their digests, so they are never moved."""
    same = F.sha2(F.col("query").cast("binary"), 256).alias("same")
    return statement.select("snapid", "dbid", "userid", same, "calls", "total_exec_time")


Shape = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class AlertInput:
    repo: Repository
    judged: DataFrame  # snapid, instid, prev_snapid, now/before texts, thresholds
    begin: int | None
    end: int | None
    prev: int | None = None  # the snapshot before, if a single one is judged
    state: DataFrame | None = None  # what was carried from it

    def fact(self, name: str) -> DataFrame:
        """Rows of judged snapshots; of a single one from its own folder only."""
        if self.begin is None or self.end is None:
            return self.repo.table(name)
        if self.begin == self.end:
            return self.repo.at(name, self.begin)
        return self.repo.between(name, self.begin, self.end)

    def earlier(self, name: str, shape: Shape) -> DataFrame:
        """Shaped rows of the snapshots before the judged ones, no older history."""
        if self.state is not None:
            return self.state_of(shape)
        if self.begin is None or self.end is None:
            return shape(self.repo.table(name))
        if self.prev is not None:
            return shape(self.repo.at(name, self.prev))
        return shape(self.repo.between(name, self.judged.agg(F.min("prev_snapid")).scalar(), self.end))

    def state_of(self, shape: Shape) -> DataFrame:
        rows = self.state.where(F.col("kind") == shape.__name__)
        if shape is xact_sums:
            return rows.select("snapid", F.col("n1").alias("rollbacks"), F.col("n2").alias("commits"))
        return rows.select("snapid", "dbid", "userid", "same", F.col("n1").alias("calls"), F.col("x").alias("total_exec_time"))


def carried_state(repo: Repository, snapid: int, instid: int) -> DataFrame:
    """Rows of ``alert_state`` after a snapshot: what the rules will compare the next one with."""
    none = F.lit(None)
    sums = xact_sums(repo.at("database", snapid)).select(
        "snapid", F.lit("xact_sums").alias("kind"), none.alias("dbid"), none.alias("userid"), none.alias("same"),
        F.col("rollbacks").alias("n1"), F.col("commits").alias("n2"), none.alias("x"),
    )
    marks = statement_marks(repo.at("statement", snapid)).select(
        "snapid", F.lit("statement_marks").alias("kind"), "dbid", "userid", "same", F.col("calls").alias("n1"), none.alias("n2"),
        F.col("total_exec_time").alias("x"),
    )
    seen = repo.spark.range(1).select(F.lit(snapid).cast("long").alias("snapid"), F.lit("seen").alias("kind"))
    rows = sums.unionByName(marks).unionByName(seen, allowMissingColumns=True)
    return rows.withColumn("instid", F.lit(instid).cast("long"))


def state_after(repo: Repository, instid: int, snapid: int) -> DataFrame | None:
    """The state carried from a snapshot, read from its server's batch; nothing if that is of another snapshot."""
    frame = repo._stored("alert_state")
    if "batch" in frame.columns:
        frame = frame.where(F.col("batch") == state_batch(instid))
    mine = frame.where((F.col("instid") == instid) & (F.col("snapid") == snapid))
    return None if mine.where("kind = 'seen'").isEmpty() else mine


def state_batch(instid: int) -> str:
    return f"i-{instid}"


def judged_snapshots(repo: Repository, begin: int | None = None, end: int | None = None) -> DataFrame:
    """Snapshots with a predecessor and enabled thresholds, in ``[begin, end]``."""
    snaps = repo.table("snapshot").select("snapid", "instid", "time")
    if end is not None:
        snaps = snaps.where(F.col("snapid") <= end)
    if begin is not None and begin == end:  # the history of its server only
        snaps = snaps.where(F.col("instid") == repo.instance_of(begin))
    length = None
    if begin is not None:
        # of older history only each server's last snapshot is needed: an aggregate, not a window
        before = snaps.where(F.col("snapid") < begin).groupBy("instid").agg(F.max(F.struct("snapid", "time")).alias("last"))
        snaps = snaps.where(F.col("snapid") >= begin).unionByName(before.select("last.snapid", "instid", "last.time"))
        length = None if end is None else end - begin + 2
    paired = with_previous(snaps, ["instid"], ["snapid", "time"], scope_length=length)
    paired = paired.where(F.col("prev_snapid").isNotNull())
    if begin is not None:
        paired = paired.where(F.col("snapid") >= begin)
    thresholds = repo.table("alert").where("enable_alert").drop("enable_alert")
    second = lambda c: seconds_rounded(F.unix_micros(F.col(c)))
    return paired.join(thresholds, "instid").select(
        "snapid",
        "instid",
        "prev_snapid",
        (second("time") - second("prev_time")).alias("lasted"),
        second_text(F.col("time")).alias("now"),
        second_text(F.col("prev_time")).alias("before"),
        *[c for c in thresholds.columns if c != "instid"],
    )


def _plain(value: Column) -> Column:
    """Number as text without trailing zeros."""
    text = value.cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _rule(
    rule: str,
    value: Column,
    threshold: str,
    message: Callable[[Column, Column], Column],
    below: bool = False,
    entity: Column | None = None,
    shown: Column | None = None,
) -> Column:
    """One threshold check: the alert's fields if it fires, else NULL."""
    limit = F.col(threshold)
    broken = (value < limit) if below else (value > limit)
    return F.when(
        (limit >= 0) & broken,
        F.struct(
            F.lit(rule).alias("rule"),
            (F.lit(None).cast("string") if entity is None else entity).alias("entity"),
            value.cast("double").alias("value"),
            limit.cast("double").alias("threshold"),
            message(_plain(value) if shown is None else shown, _plain(limit)).alias("message"),
        ),
    )


def _fire(df: DataFrame, *rules: Column) -> DataFrame:
    """Alerts of all checks on one frame, which is read once however many checks there are."""
    fired = F.filter(F.array(*rules), lambda alert: alert.isNotNull())
    return df.select("snapid", F.explode(fired).alias("alert")).select("snapid", "alert.*")


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _between_text(lead: str, value: Column, unit: str, limit: Column) -> Column:
    return _text(
        f"{lead} in snapshots between '", F.col("before"), "' and '", F.col("now"), "' --- ", value,
        f" {unit} (threshold = ", limit, f" {unit})",
    )


def _at_text(lead: str, value: Column, limit: Column, unit: str = "", who: Column | None = None) -> Column:
    unit = f" {unit}" if unit else ""
    named = () if who is None else ("'", who, "', ")
    return _text(
        f"{lead} in snapshot '", F.col("now"), "' --- ", *named, value, f"{unit} (threshold = ", limit, f"{unit})"
    )


def rule_xact(given: AlertInput) -> DataFrame:
    sums = xact_sums(given.fact("database"))
    earlier = given.earlier("database", xact_sums).select(
        F.col("snapid").alias("prev_snapid"), F.col("rollbacks").alias("p_rollbacks"), F.col("commits").alias("p_commits")
    )
    both = given.judged.join(sums, "snapid").join(earlier, "prev_snapid")
    rollbacks = div(F.col("rollbacks") - F.col("p_rollbacks"), F.col("lasted"))
    commits = div(F.col("commits") - F.col("p_commits"), F.col("lasted"))
    return _fire(
        both,
        _rule("rollback_tps", rollbacks, "rollback_tps", lambda v, t: _between_text("too many rollbacks", v, "Rollbacks/sec", t)),
        _rule("commit_tps", commits, "commit_tps", lambda v, t: _between_text("too many transactions", v, "Transactions/sec", t)),
    )


def rule_garbage(given: AlertInput) -> DataFrame:
    tables = view_tables(given.repo, given.fact).select(
        "snapid", "database", "schema", "table", "size", "relpages",
        div(F.col("n_dead_tup"), F.col("n_live_tup") + F.col("n_dead_tup")).alias("dead"),
    )
    big = F.col("relpages") >= MIN_PAGES
    garbage = F.col("size").cast("decimal(20,0)") * F.col("dead").cast("decimal(12,3)")
    sums = tables.groupBy("snapid").agg(
        F.sum(garbage).alias("garbage"),
        F.sum(F.when(big, garbage)).alias("big_garbage"),
        F.sum(F.when(big, F.col("size"))).alias("big_size"),
    )
    totals = given.judged.join(sums, "snapid")
    each = given.judged.join(tables.where(big), "snapid")
    who = _text(F.col("database"), ".", F.col("schema"), ".", F.col("table"))
    size_text = lambda v, t: _at_text("dead tuple size exceeds threshold", v, t, "MiB")
    ratio_text = lambda v, t: _at_text("dead tuple ratio exceeds threshold", v, t, "%")
    table_text = lambda v, t: _text(
        "dead tuple ratio in '", who, "' exceeds threshold in snapshot '", F.col("now"), "' --- ", v, " % (threshold = ", t, " %)"
    )
    summed = _fire(
        totals,
        _rule("garbage_size", div(F.col("garbage"), F.lit(1048576)), "garbage_size", size_text),
        _rule("garbage_percent", div(F.col("big_garbage") * 100, F.col("big_size")), "garbage_percent", ratio_text),
    )
    single = _fire(each, _rule("garbage_percent_table", F.col("dead") * 100, "garbage_percent_table", table_text, entity=who))
    return summed.unionByName(single)


def rule_query(given: AlertInput) -> DataFrame:
    """Mean time per call since the previous snapshot, matched on the query text."""
    earlier = given.earlier("statement", statement_marks).select(
        F.col("snapid").alias("prev_snapid"), "dbid", "userid", "same", F.col("calls").alias("p_calls"),
        F.col("total_exec_time").alias("p_time"),
    )
    now = given.judged.select("snapid", "prev_snapid").join(statement_marks(given.fact("statement")), "snapid")
    matched = now.join(earlier, ["prev_snapid", "dbid", "userid", "same"], "left")
    calls = F.col("calls") - F.coalesce("p_calls", F.lit(0))
    spent = F.col("total_exec_time") - F.coalesce("p_time", F.lit(0.0))
    per_call = matched.where(calls != 0).select("snapid", (spent / calls).alias("per_call"))
    times = per_call.groupBy("snapid").agg(F.avg("per_call").alias("mean"), F.max("per_call").alias("worst"))
    both = given.judged.join(times, "snapid")
    cents = lambda c: F.col(c).cast("decimal(38,12)").cast("decimal(10,2)").cast("string")
    mean_text = lambda v, t: _between_text("Query average response time exceeds threshold", v, "sec", t)
    worst_text = lambda v, t: _between_text("Query worst response time exceeds threshold", v, "sec", t)
    return _fire(
        both,
        _rule("response_avg", F.col("mean"), "response_avg", mean_text, shown=cents("mean")),
        _rule("response_worst", F.col("worst"), "response_worst", worst_text, shown=cents("worst")),
    )


def rule_activity(given: AlertInput) -> DataFrame:
    both = given.judged.join(given.fact("activity").select("snapid", "max_backends"), "snapid")
    text = lambda v, t: _at_text("too many backends", v, t)
    return _fire(both, _rule("backend_max", F.col("max_backends"), "backend_max", text))


def rule_correlation(given: AlertInput) -> DataFrame:
    clustered = view_indexes(given.repo, given.fact).where("isclustered").select(
        "snapid", "dbid", "tbl", "database", "schema", "table", F.get("indkey", F.lit(0)).alias("attnum")
    )
    column = (
        given.fact("column")
        .where(F.col("correlation").isNotNull())
        .select("snapid", "dbid", "tbl", "attnum", "correlation")
    )
    both = given.judged.join(clustered.join(column, ["snapid", "dbid", "tbl", "attnum"]), "snapid")
    percent = (F.abs("correlation").cast("double") * 100).cast("decimal(38,12)").cast("decimal(5,2)")
    who = _text(F.col("database"), ".", F.col("schema"), ".", F.col("table"))
    text = lambda v, t: _at_text(
        "correlation of the clustered table fell below threshold", v, t, "%", who=who
    )
    return _fire(both, _rule("correlation_percent", percent, "correlation_percent", text, below=True, entity=who))


def rule_resource(given: AlertInput) -> DataFrame:
    disk = given.judged.join(given.fact("tablespace").select("snapid", "name", "avail", "total"), "snapid")
    load = given.judged.join(given.fact("loadavg"), "snapid")
    memory = given.judged.join(given.fact("memory").select("snapid", "swap"), "snapid")
    disk_text = lambda v, t: _text(
        "free disk space ratio at '", F.col("name"), "' fell below threshold in snapshot '", F.col("now"), "' --- ", v,
        " % (threshold = ", t, " %)",
    )
    free = div(F.col("avail"), F.col("total")) * 100
    loads = [
        _rule(
            f"loadavg_{m}min", F.col(f"loadavg{m}"), f"loadavg_{m}min",
            lambda v, t, m=m: _at_text(f"load average {m}min exceeds threshold", v, t),
        )
        for m in (1, 5, 15)
    ]
    swap_text = lambda v, t: _at_text("memory swap size exceeds threshold", v, t, "KiB")
    return (
        _fire(disk, _rule("disk_remain_percent", free, "disk_remain_percent", disk_text, below=True, entity=F.col("name")))
        .unionByName(_fire(load, *loads))
        .unionByName(_fire(memory, _rule("swap_size", F.col("swap"), "swap_size", swap_text)))
    )


def rule_replication(given: AlertInput) -> DataFrame:
    senders = given.fact("replication").where(
        F.col("flush_location").isNotNull() & F.col("replay_location").isNotNull()
    )
    both = given.judged.join(senders, "snapid")
    client = _text(host(F.col("client_addr")), ":", F.col("client_port").cast("string"))

    def lag(of: str) -> Column:
        behind = lsn_diff(lsn_part(F.col("current_location")), lsn_part(F.col(of)))
        return div(behind, F.lit(1048576))

    def text(lead: str):
        return lambda v, t: _text(
            f"{lead} in '", client, "' exceeds threshold in snapshot '", F.col("now"), "' --- ", v,
            " MiB (threshold = ", t, " MiB)",
        )

    return _fire(
        both,
        _rule("rep_flush_delay", lag("flush_location"), "rep_flush_delay", text("WAL flush-delay"), entity=client),
        _rule("rep_replay_delay", lag("replay_location"), "rep_replay_delay", text("replay-delay"), entity=client),
    )


RULES: dict[str, Callable[[AlertInput], DataFrame]] = {
    "xact": rule_xact,
    "garbage": rule_garbage,
    "query": rule_query,
    "activity": rule_activity,
    "correlation": rule_correlation,
    "resource": rule_resource,
    "replication": rule_replication,
}


def alerts(
    repo: Repository,
    begin: int | None = None,
    end: int | None = None,
    rules: Mapping[str, Callable[[AlertInput], DataFrame]] = RULES,
) -> DataFrame:
    """Messages of all rules for the snapshots in ``[begin, end]``, with their rule order.

    For a single snapshot its one row of ``judged`` comes to the driver: facts are then read from that snapshot's folder, and
    the values before from the state carried by its server, or, if that is missing, from the one folder of the snapshot before.
    """
    judged = judged_snapshots(repo, begin, end)
    given = AlertInput(repo, judged, begin, end)
    if begin is not None and begin == end and rules:
        row = judged.collect()
        if row:
            state = state_after(repo, row[0]["instid"], row[0]["prev_snapid"])
            given = AlertInput(repo, repo.spark.createDataFrame(row, judged.schema), begin, end, row[0]["prev_snapid"], state)
    fired = [
        rule(given).select(*RULE_COLUMNS).withColumn("ordinal", F.lit(i)) for i, rule in enumerate(rules.values())
    ]
    if not fired:
        names = "snapid bigint, rule string, entity string, value double, threshold double, message string, ordinal int"
        return repo.spark.createDataFrame([], names)
    return reduce(DataFrame.unionByName, fired)


def alert(repo: Repository, snapid: int) -> DataFrame:
    """Alert texts of one snapshot in rule order."""
    return alerts(repo, snapid, snapid).orderBy("ordinal", "rule", "entity").select("message")


def as_log_rows(messages: DataFrame, repo: Repository) -> DataFrame:
    """Alert messages as ``log`` rows of level ALERT at their snapshot's time."""
    snaps = repo.table("snapshot").select("snapid", "instid", F.col("time").alias("timestamp"))
    return messages.join(snaps, "snapid").select("instid", "timestamp", F.lit("ALERT").alias("elevel"), "message")
