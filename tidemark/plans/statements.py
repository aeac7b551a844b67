"""Query activity: functions, statements, resource usage, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clock import to_second
from tidemark.functions.numeric import div, round_real, sub
from tidemark.operators.delta import endpoint_pair, registry
from tidemark.operators.ranking import asc, desc, top
from tidemark.plans.common import grew
from tidemark.repository import Repository

TOP_QUERIES = 20
MS = "decimal(30,3)"

_BLOCK_TIMES = [f"{area}_blk_{op}_time" for area in ("shared", "local", "temp") for op in ("read", "write")]


def query_functions(repo: Repository, begin: int, end: int, limit: int | None = None) -> DataFrame:
    pair = endpoint_pair(
        repo.at("function", begin, end),
        ["dbid", "nsp", "funcid"],
        begin,
        end,
        ["calls", "total_time", "self_time"],
        at_end=["funcname"],
    )
    database = repo.at("database", end).select("dbid", F.col("name").alias("datname"))
    schema = repo.at("schema", end).select("dbid", "nsp", F.col("name").alias("nspname"))
    report = (
        pair.join(database, "dbid")
        .join(schema, ["dbid", "nsp"])
        .select(
            "funcid",
            "datname",
            "nspname",
            F.col("e_funcname").alias("proname"),
            grew("calls").alias("calls"),
            round_real(grew("total_time"), MS).alias("total_time"),
            round_real(grew("self_time"), MS).alias("self_time"),
            div(grew("total_time"), grew("calls")).alias("time_per_call"),
        )
    )
    return top(report, [desc("total_time"), desc("self_time"), desc("calls"), asc("funcid"), asc("datname")], limit)


def _scoped(repo: Repository, name: str, begin: int, end: int) -> DataFrame:
    return repo.scoped(name, begin, end)


def _per(total: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit(0).cast(MS)).otherwise(round_real(total / n, MS))


COUNTERS = ["plans", "total_plan_time", "calls", "total_exec_time", *_BLOCK_TIMES]


def _statement_registry(repo: Repository, begin: int, end: int) -> DataFrame:
    seen = registry(
        _scoped(repo, "statement", begin, end), ["dbid", "userid", "queryid"], begin, COUNTERS, texts=["query"]
    )
    return seen.where((grew("calls") > 0) & (grew("total_exec_time") > 0))


def statement_columns() -> list[Column]:
    """Figures of one named statement."""
    plans, calls = grew("plans"), grew("calls")
    return [
        "rolname",
        "datname",
        "query",
        plans.alias("plans"),
        round_real(grew("total_plan_time"), MS).alias("total_plan_time"),
        _per(grew("total_plan_time"), plans).alias("time_per_plan"),
        calls.alias("calls"),
        round_real(grew("total_exec_time"), MS).alias("total_exec_time"),
        _per(grew("total_exec_time"), calls).alias("time_per_call"),
        *[round_real(grew(c), MS).alias(c.replace("temp_", "tmp_")) for c in _BLOCK_TIMES],
        "dbid",
        "userid",
        "queryid",
        "last",
    ]


def query_statements(
    repo: Repository, begin: int, end: int, limit: int | None = None, names_as_of: str = "begin"
) -> DataFrame:
    """Statements seen in the scope, from ``begin`` to each one's last snapshot.

    Names are those of ``begin`` (entities created later drop out); with
    ``names_as_of='last'`` each statement is named as of its last snapshot.
    """
    seen = _statement_registry(repo, begin, end)
    named = _with_names(repo, seen, begin, end, names_as_of)
    report = named.select(*statement_columns())
    return top(report, _statement_order(), limit)


def _statement_order() -> list[Column]:
    return [desc("total_exec_time"), desc("calls"), asc("dbid"), asc("userid"), asc("queryid")]


def _with_names(repo: Repository, seen: DataFrame, begin: int, end: int, as_of: str) -> DataFrame:
    if as_of == "begin":
        database = repo.at("database", begin).select("dbid", F.col("name").alias("datname"))
        role = repo.at("role", begin).select("userid", F.col("name").alias("rolname"))
        return seen.join(database, "dbid").join(role, "userid")
    database = repo.scoped("database", begin, end).select(
        F.col("snapid").alias("last"), "dbid", F.col("name").alias("datname")
    )
    role = repo.scoped("role", begin, end).select(
        F.col("snapid").alias("last"), "userid", F.col("name").alias("rolname")
    )
    return seen.join(database, ["last", "dbid"]).join(role, ["last", "userid"])


_USAGE = ["reads", "writes", "user_time", "system_time"]


def query_statements_rusage(repo: Repository, begin: int, end: int, limit: int | None = None) -> DataFrame:
    statements = query_statements(repo, begin, end).select(
        "rolname", "datname", "query", "total_exec_time", "calls", "dbid", "userid", "queryid", "last"
    )
    kept = [f"{kind}_{u}" for kind in ("plan", "exec") for u in _USAGE]
    key = ["dbid", "userid", "queryid"]
    at_begin = repo.at("rusage", begin).select(*key, *[F.col(c).alias(f"b_{c}") for c in kept])
    at_last = repo.scoped("rusage", begin, end).select(
        *key, F.col("snapid").alias("last"), *[F.col(c).alias(f"e_{c}") for c in kept]
    )
    joined = statements.join(at_last, [*key, "last"]).join(at_begin, key, "left")

    def out(c: str) -> Column:
        grown = sub(F.col(f"e_{c}"), F.col(f"b_{c}"))
        if c.endswith("_time"):
            short = c.replace("_system_time", "_sys_times").replace("_user_time", "_user_times")
            return round_real(grown, "decimal(30,6)").alias(short)
        return grown.alias(c)

    return top(joined, _statement_order(), limit).select("rolname", "datname", "query", *[out(c) for c in kept])


def _plan_registry(repo: Repository, begin: int, end: int, latest: tuple[str, ...] = ()) -> DataFrame:
    seen = registry(
        _scoped(repo, "plan", begin, end),
        ["queryid", "planid", "dbid", "userid"],
        begin,
        ["calls", "total_time", *_BLOCK_TIMES],
        latest=latest,
    )
    return seen.where((grew("calls") > 0) & (grew("total_time") > 0))


def _plan_figures() -> list[Column]:
    return [
        grew("calls").alias("calls"),
        round_real(grew("total_time"), MS).alias("total_time"),
        div(grew("total_time"), grew("calls")).alias("time_per_call"),
        *[round_real(grew(c), MS).alias(c) for c in _BLOCK_TIMES],
    ]


def _plan_order() -> list[Column]:
    return [desc("total_time"), desc("calls"), asc("queryid"), asc("planid"), asc("datname"), asc("rolname")]


def query_plans(
    repo: Repository, begin: int, end: int, limit: int | None = None, names_as_of: str = "begin"
) -> DataFrame:
    named = _with_names(repo, _plan_registry(repo, begin, end), begin, end, names_as_of)
    report = named.select("queryid", "planid", "rolname", "datname", *_plan_figures())
    return top(report, _plan_order(), limit)


def query_plans_report(repo: Repository, begin: int, end: int) -> DataFrame:
    """Plans of statements seen in the scope, with call times and query text."""
    seen = _plan_registry(repo, begin, end, latest=("first_call", "last_call"))
    text = (
        _scoped(repo, "statement", begin, end)
        .groupBy("queryid", "dbid", "userid")
        .agg(F.max("query").alias("query"))
    )
    named = _with_names(repo, seen, begin, end, "last").join(text, ["queryid", "dbid", "userid"])
    report = named.select(
        "queryid",
        "planid",
        "rolname",
        "datname",
        *_plan_figures(),
        to_second(F.col("e_first_call")).alias("first_call"),
        to_second(F.col("e_last_call")).alias("last_call"),
        "query",
        F.col("last").alias("snapid"),
        "dbid",
        "userid",
    )
    return top(report, _plan_order(), None)
