"""Run registered queries beside their SQL and compare the rows."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canon(value):
    import decimal
    import math

    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        return 0.0 if number == 0 else round(number, 9)
    if hasattr(value, "tolist") and not isinstance(value, (str, bytes)):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(canon(v) for v in value.asDict().values())
    if isinstance(value, dict):
        return tuple(canon(v) for v in value.values())
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(df, con, sql: str) -> str:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want[0] != got[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(want[1]) != len(got[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return f"{len(bad)} rows differ, first spark={bad[0][0]} sql={bad[0][1]}"
    return ""


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from assetspark.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    plans, sqls = queries(), oracle_sql()
    failed = 0
    for name, plan in plans.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            df = plan(spark, sf_dir)
            if name in sqls:
                message = compare(df, con, sqls[name])
                n = ""
            else:
                message, n = "", f"rows-only {df.count()}"
        except Exception as error:  # report and go on
            message, n = f"{type(error).__name__}: {str(error)[:600]}", ""
        failed += bool(message)
        print(f"{'FAIL' if message else 'ok  '} {name} {time.time() - began:.2f}s {n} {message}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
