"""Run registered queries next to their SQL on DuckDB: ``python tests/oracle_check.py [folder] [names...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        return f"DECIMAL {v}"
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())


def compare(spark, con, folder, name, run, sql):
    """None when equal, else a text saying how the results differ."""
    cols, rows = spark_rows(run(spark, folder))
    if sql is None:
        return None if rows else "no rows"
    ocols, orows = duck_rows(con, sql)
    if cols != ocols:
        return f"columns {cols} != {ocols}"
    if len(rows) != len(orows):
        return f"rows {len(rows)} != {len(orows)}; first {rows[:2]} | {orows[:2]}"
    if not rows:
        return "both empty"
    bad = [(a, b) for a, b in zip(rows, orows) if a != b]
    if bad:
        a, b = bad[0]
        diff = [(c, x, y) for c, x, y in zip(cols, a, b) if x != y]
        return f"{len(bad)}/{len(rows)} rows differ: {diff[:4]}"
    return None


def main(folder="/root/testdata/sf0.001", *only):
    import __spark_entry__ as contract
    from inkstream.session import build_session

    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    sqls = contract.oracle_sql()
    failed, total = [], 0
    for name, run in contract.queries().items():
        if only and not any(o in name for o in only):
            continue
        total += 1
        t0 = time.time()
        try:
            problem = compare(spark, con, folder, name, run, sqls.get(name))
        except Exception as e:  # report and go on with the other queries
            problem = "ERROR " + "".join(traceback.format_exception_only(e))[:700]
        took = time.time() - t0
        if problem:
            failed.append(name)
            print(f"FAIL {name} {took:.1f}s {problem}", flush=True)
        elif only or took > 3:
            print(f"ok   {name} {took:.1f}s{'' if name in sqls else ' (rows only)'}", flush=True)
    print(f"{total - len(failed)}/{total} ok; failed: {failed}")


if __name__ == "__main__":
    main(*sys.argv[1:])
