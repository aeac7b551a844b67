"""Alert rules over all snapshots of a range."""

from functools import partial

from tidemark.plans import alerts
from workload.oracle import big, div3, lsn, ratio, sec_text, units
from workload.registry import add

LO, HI = 5, 55

JUDGED = f"""
j AS (SELECT snapid, prev_snapid, {sec_text("time")} AS now, {sec_text("prev_time")} AS before,
             (epoch_us(time) + 500000) // 1000000 - (epoch_us(prev_time) + 500000) // 1000000 AS lasted, a.*
      FROM (SELECT snapid, instid, time, LAG(snapid) OVER w AS prev_snapid, LAG(time) OVER w AS prev_time
            FROM snapshot WINDOW w AS (PARTITION BY instid ORDER BY snapid)) s JOIN alert a USING (instid)
      WHERE enable_alert AND prev_snapid IS NOT NULL AND snapid BETWEEN {LO} AND {HI})"""


def text3(u: str) -> str:
    """Thousandths as number text without trailing zeros."""
    return f"regexp_replace(regexp_replace(CAST(CAST({u} AS BIGINT) // 1000 AS VARCHAR) || '.' || lpad(CAST(CAST({u} AS BIGINT) % 1000 AS VARCHAR), 3, '0'), '0+$', ''), '[.]$', '')"


def floats(c: str) -> str:
    return f"regexp_replace(CAST(CAST({c} AS DECIMAL(12,2)) AS VARCHAR), '[.]?0+$', '')"


def pair_text(lead: str, shown: str, unit: str, limit: str) -> str:
    return f"'{lead} in snapshots between ''' || before || ''' and ''' || now || ''' --- ' || {shown} || ' {unit} (threshold = ' || {limit} || ' {unit})'"


def at_text(lead: str, shown: str, limit: str, unit: str = "", who: str = "") -> str:
    u = f" {unit}" if unit else ""
    named = f"'''' || {who} || ''', ' || " if who else ""
    return f"'{lead} in snapshot ''' || now || ''' --- ' || {named}{shown} || '{u} (threshold = ' || {limit} || '{u})'"


def out(rule: str, value: str, limit: str, message: str, source: str, when: str, entity: str = "CAST(NULL AS VARCHAR)") -> str:
    return f"""SELECT snapid, '{rule}' AS rule, {entity} AS entity, {value} AS value, CAST({limit} AS DOUBLE) AS threshold, {message} AS message
FROM {source} WHERE {limit} >= 0 AND {when}"""


NAMED = """
v AS (SELECT t.*, d.name || '.' || s.name || '.' || t.name AS who FROM "table" t JOIN database d ON d.snapid = t.snapid AND d.dbid = t.dbid
           JOIN schema s ON s.snapid = t.snapid AND s.dbid = t.dbid AND s.nsp = t.nsp)"""

SQL = {}
SQL["xact"] = (
    f"""
sx AS (SELECT snapid, SUM(xact_commit) AS c, SUM(xact_rollback) AS r FROM database GROUP BY snapid),
rx AS (SELECT j.*, {div3("n.c - p.c", "lasted")} AS c3, {div3("n.r - p.r", "lasted")} AS r3
       FROM j JOIN sx n USING (snapid) JOIN sx p ON p.snapid = j.prev_snapid)""",
    out("rollback_tps", "CAST(r3 AS DOUBLE) / 1000", "rollback_tps", pair_text("too many rollbacks", text3("r3"), "Rollbacks/sec", "rollback_tps"), "rx", "r3 > rollback_tps * 1000")
    + " UNION ALL "
    + out("commit_tps", "CAST(c3 AS DOUBLE) / 1000", "commit_tps", pair_text("too many transactions", text3("c3"), "Transactions/sec", "commit_tps"), "rx", "c3 > commit_tps * 1000"),
)
_DEAD = div3("n_dead_tup", "n_live_tup + n_dead_tup")
SQL["garbage"] = (
    NAMED
    + f""",
dx AS (SELECT snapid, who, size, relpages, {_DEAD} AS dead3 FROM v),
gx AS (SELECT snapid, SUM(size * dead3) AS g, SUM(size * dead3) FILTER (relpages >= 1000) AS bg, SUM(size) FILTER (relpages >= 1000) AS bs FROM dx GROUP BY snapid),
hx AS (SELECT j.*, {div3("g", "1048576000")} AS mb3, {div3("bg * 100", "bs * 1000")} AS pc3 FROM j JOIN gx USING (snapid)),
ex AS (SELECT j.*, who, dead3 * 100 AS pc3 FROM j JOIN dx USING (snapid) WHERE relpages >= 1000)""",
    out("garbage_size", "CAST(mb3 AS DOUBLE) / 1000", "garbage_size", at_text("dead tuple size exceeds threshold", text3("mb3"), "garbage_size", "MiB"), "hx", "mb3 > garbage_size * 1000")
    + " UNION ALL "
    + out("garbage_percent", "CAST(pc3 AS DOUBLE) / 1000", "garbage_percent", at_text("dead tuple ratio exceeds threshold", text3("pc3"), "garbage_percent", "%"), "hx", "pc3 > garbage_percent * 1000")
    + " UNION ALL "
    + out(
        "garbage_percent_table", "CAST(pc3 AS DOUBLE) / 1000", "garbage_percent_table",
        f"'dead tuple ratio in ''' || who || ''' exceeds threshold in snapshot ''' || now || ''' --- ' || {text3('pc3')} || ' % (threshold = ' || garbage_percent_table || ' %)'",
        "ex", "pc3 > garbage_percent_table * 1000", "who",
    ),
)
_TWO = "CAST(CAST(round({0}, 2) AS DECIMAL(18,2)) AS VARCHAR)"
SQL["query"] = (
    """
qx AS (SELECT j.snapid, (c.total_exec_time - COALESCE(p.total_exec_time, 0)) / (c.calls - COALESCE(p.calls, 0)) AS t
       FROM j JOIN statement c USING (snapid) LEFT JOIN statement p ON p.snapid = j.prev_snapid AND p.dbid = c.dbid AND p.userid = c.userid AND p.query = c.query
       WHERE c.calls <> COALESCE(p.calls, 0)),
ax AS (SELECT j.*, g.mean, g.worst FROM j JOIN (SELECT snapid, AVG(t) AS mean, MAX(t) AS worst FROM qx GROUP BY snapid) g USING (snapid))""",
    out("response_avg", "round(mean, 4)", "response_avg", pair_text("Query average response time exceeds threshold", _TWO.format("mean"), "sec", "response_avg"), "ax", "mean > response_avg")
    + " UNION ALL "
    + out("response_worst", "round(worst, 4)", "response_worst", pair_text("Query worst response time exceeds threshold", _TWO.format("worst"), "sec", "response_worst"), "ax", "worst > response_worst"),
)
SQL["activity"] = (
    "bx AS (SELECT j.*, max_backends FROM j JOIN activity USING (snapid))",
    out("backend_max", "CAST(max_backends AS DOUBLE)", "backend_max", at_text("too many backends", "max_backends", "backend_max"), "bx", "max_backends > backend_max"),
)
_COR = "CAST(round(abs(CAST(correlation AS DOUBLE)) * 10000) AS BIGINT)"
SQL["correlation"] = (
    NAMED
    + f""",
kx AS (SELECT j.*, who, {_COR} * 10 AS c3 FROM j JOIN "index" i USING (snapid) JOIN v ON v.snapid = i.snapid AND v.dbid = i.dbid AND v.tbl = i.tbl
       JOIN "column" c ON c.snapid = i.snapid AND c.dbid = i.dbid AND c.tbl = i.tbl AND c.attnum = i.indkey[1]
       WHERE i.isclustered AND correlation IS NOT NULL)""",
    out("correlation_percent", "CAST(c3 AS DOUBLE) / 1000", "correlation_percent", at_text("correlation of the clustered table fell below threshold", text3("c3"), "correlation_percent", "%", "who"), "kx", "c3 < correlation_percent * 1000", "who"),
)


def _load(m: int) -> str:
    return out(
        f"loadavg_{m}min", f"round(CAST(loadavg{m} AS DOUBLE), 4)", f"loadavg_{m}min",
        at_text(f"load average {m}min exceeds threshold", floats(f"loadavg{m}"), floats(f"loadavg_{m}min")), "lx", f"loadavg{m} > loadavg_{m}min",
    )


SQL["resource"] = (
    f"""
tx AS (SELECT j.*, name, {div3("avail", "total")} * 100 AS p3 FROM j JOIN tablespace USING (snapid)),
lx AS (SELECT j.*, loadavg1, loadavg5, loadavg15 FROM j JOIN loadavg USING (snapid)),
mx AS (SELECT j.*, swap FROM j JOIN memory USING (snapid))""",
    out(
        "disk_remain_percent", "CAST(p3 AS DOUBLE) / 1000", "disk_remain_percent",
        f"'free disk space ratio at ''' || name || ''' fell below threshold in snapshot ''' || now || ''' --- ' || {text3('p3')} || ' % (threshold = ' || disk_remain_percent || ' %)'",
        "tx", "p3 < disk_remain_percent * 1000", "name",
    )
    + "".join(" UNION ALL " + _load(m) for m in (1, 5, 15))
    + " UNION ALL "
    + out("swap_size", "CAST(swap AS DOUBLE)", "swap_size", at_text("memory swap size exceeds threshold", "swap", "swap_size", "KiB"), "mx", "swap > swap_size"),
)


def _lag(rule: str, lead: str, col: str) -> str:
    return out(
        rule, f"CAST({col} AS DOUBLE) / 1000", rule,
        f"'{lead} in ''' || who || ''' exceeds threshold in snapshot ''' || now || ''' --- ' || {text3(col)} || ' MiB (threshold = ' || {rule} || ' MiB)'",
        "px", f"{col} > {rule} * 1000", "who",
    )


SQL["replication"] = (
    f"""
px AS (SELECT j.*, split_part(client_addr, '/', 1) || ':' || client_port AS who,
              {div3(f"{lsn('current_location')} - {lsn('flush_location')}", "1048576")} AS f3,
              {div3(f"{lsn('current_location')} - {lsn('replay_location')}", "1048576")} AS r3
       FROM j JOIN replication USING (snapid) WHERE flush_location IS NOT NULL AND replay_location IS NOT NULL)""",
    _lag("rep_flush_delay", "WAL flush-delay", "f3") + " UNION ALL " + _lag("rep_replay_delay", "replay-delay", "r3"),
)


def _run(names, repo):
    chosen = {n: alerts.RULES[n] for n in names}
    fired = alerts.alerts(repo, LO, HI, rules=chosen)
    return fired.selectExpr("snapid", "rule", "entity", "round(value, 4) AS value", "threshold", "message")


for _name, (_ctes, _body) in SQL.items():
    add(f"alert_{_name}", partial(_run, [_name]), f"WITH {JUDGED}, {_ctes.strip()} {_body}")

_all = [SQL[n] for n in alerts.RULES]
_seen: list[str] = []
for _ctes, _ in _all:
    text = _ctes.strip().replace(NAMED.strip() + ",", "").strip()
    _seen.append(text)
add(
    "alert_union",
    partial(_run, list(alerts.RULES)),
    f"WITH {JUDGED}, {NAMED.strip()}, {', '.join(_seen)} " + " UNION ALL ".join(b for _, b in _all),
)
add(
    "previous_snapshot",
    lambda r: alerts.judged_snapshots(r, LO, HI).select("snapid", "prev_snapid", "lasted"),
    f"WITH {JUDGED} SELECT snapid, prev_snapid, lasted FROM j",
)
add(
    "alert_sink_rows",
    lambda r: alerts.as_log_rows(alerts.alerts(r, LO, HI, rules={"activity": alerts.rule_activity}), r),
    f"""WITH {JUDGED}, {SQL["activity"][0]}, o AS ({SQL["activity"][1]})
SELECT s.instid, strftime(s.time, '%Y-%m-%d %H:%M:%S.%f') AS "timestamp", 'ALERT' AS elevel, o.message FROM o JOIN snapshot s USING (snapid)""",
)
