"""Compare every registered query with its SQL: ``python -m workload.check [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb

from tidemark import build_session
from workload.frames import BASE_TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, build, sql):
    t0 = time.time()
    df = build(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - t0
    if sql is None:
        return f"rows={len(got)} (no SQL)", True, spent
    cur = con.execute(sql)
    want = cur.fetchall()
    names = [d[0] for d in cur.description]
    kinds = {str(d[1]) for d in cur.description}
    if sorted(names) != sorted(df.columns):
        return f"columns differ: spark={sorted(df.columns)} sql={sorted(names)}", False, spent
    odd = kinds - {"BIGINT", "DOUBLE", "VARCHAR", "BOOLEAN"}
    if odd:
        return f"odd SQL types {[(d[0], str(d[1])) for d in cur.description if str(d[1]) in odd]}", False, spent
    mine = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    theirs = {d[0]: str(d[1]) for d in cur.description}
    pairs = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    bad = [(n, mine[n], theirs[n]) for n in names if mine[n] != pairs[theirs[n]]]
    if bad:
        return f"types differ {bad}", False, spent
    a, b = normal(got, df.columns), normal(want, names)
    if a == b:
        return f"rows={len(a)}", True, spent
    diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return f"rows {len(a)} vs {len(b)}; columns {sorted(names)}; first {diff}", False, spent


def main(argv):
    from workload import ORACLES, QUERIES

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("check", master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = []
    for name in argv[1:] or QUERIES:
        try:
            note, ok, spent = compare(spark, con, sf_dir, QUERIES[name], ORACLES.get(name))
        except Exception as e:  # noqa: BLE001
            note, ok, spent = f"{type(e).__name__}: {str(e)[:900]}", False, 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {spent:6.2f}s {note}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
