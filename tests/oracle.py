"""Compare registered queries with their SQL twins: ``python -m tests.oracle [--sf DIR] [name ...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat(" ")
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    if isinstance(value, dict):
        return {k: plain(x) for k, x in value.items()}
    return str(value)


def kind(value):
    if value is None:
        return None
    return {"bool": "bool", "int": "int", "float": "float", "Decimal": "decimal"}.get(type(value).__name__, type(value).__name__)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(plain(r[i])) for i in order) for r in rows)


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def compare(spark, folder: str, make, sql: str | None, con=None) -> tuple[bool, str]:
    df = make(spark, folder)
    got = [tuple(r) for r in df.collect()]
    cols, mine = rows_of(df.columns, got)
    if sql is None:
        return len(mine) > 0, f"rows={len(mine)} (no oracle)"
    con = con or connect(folder)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    ocols, theirs = rows_of(names, want)
    if cols != ocols:
        return False, f"columns {cols} != {ocols}"
    kinds = [{kind(r[df.columns.index(c)]) for r in got} - {None} for c in cols]
    okinds = [{kind(r[names.index(c)]) for r in want} - {None} for c in cols]
    for c, a, b in zip(cols, kinds, okinds):
        if a and b and a != b:
            return False, f"type of {c}: {a} != {b}"
    if len(mine) != len(theirs):
        return False, f"rows {len(mine)} != {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        diff = [(c, x, y) for c, x, y in zip(cols, *bad[0]) if x != y]
        only = sorted(set(mine) - set(theirs))[:2], sorted(set(theirs) - set(mine))[:2]
        return False, f"{len(bad)}/{len(mine)} rows differ, first {diff[:4]} :: {str(only)[:900]}"
    empty = "" if mine else " EMPTY"
    return bool(mine), f"rows={len(mine)}{empty}"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from weekloom.runtime import build_session

    folder = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        folder, argv = argv[1], argv[2:]
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    bad = 0
    for n in names:
        t = time.time()
        try:
            ok, note = compare(spark, folder, queries[n], oracles.get(n), con)
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n} {time.time() - t:.1f}s {note}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
