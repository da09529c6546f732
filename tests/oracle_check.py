"""Run registered queries beside their SQL in DuckDB: python tests/oracle_check.py [prefix ...] [--sf DIR]."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return "decimal:" + str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"f{v:.9g}"
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{canon(k)}:{canon(v[k])}" for k in sorted(v, key=str)) + "}"
    return repr(v)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


SPARK_TYPE = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def compare(spark_df, con, sql):
    cols = sorted(spark_df.columns)
    theirs = {r[0]: SPARK_TYPE.get(r[1], r[1]) for r in con.execute("DESCRIBE " + sql).fetchall()}
    types = {c: (t, theirs.get(c)) for c, t in spark_df.dtypes if theirs.get(c) != t}
    if types:
        return f"types differ (spark, sql): {types}", -1
    ours = sorted(tuple(canon(r[c]) for c in cols) for r in spark_df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns differ: spark={cols} sql={sorted(names)}", len(ours)
    pos = [names.index(c) for c in cols]
    theirs = sorted(tuple(canon(r[i]) for i in pos) for r in cur.fetchall())
    if ours == theirs:
        return None, len(ours)
    a, b = set(ours), set(theirs)
    return (
        f"rows spark={len(ours)} sql={len(theirs)}\n   cols={cols}\n   only spark: {sorted(a - b)[:2]}\n   only sql:   {sorted(b - a)[:2]}",
        len(ours),
    )


def main(argv):
    import __spark_entry__ as entry
    from tracewright.session import get_spark

    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    spark = get_spark("oracle-check", 8)
    con = connect(sf)
    sql = entry.oracle_sql()
    bad = []
    for name, fn in entry.queries().items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            if name in sql:
                t1 = time.time()
                err, n = compare(df, con, sql[name])
            else:
                err, n = None, len(df.collect())
        except Exception as e:  # report and go on
            err, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        mark = "ok  " if err is None else "FAIL"
        if err:
            bad.append(name)
        print(f"{mark} {name:34s} rows={n:<7d} {time.time() - t0:6.2f}s {'' if name in sql else '(rows only)'} {err or ''}", flush=True)
    print(f"failed {len(bad)}: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
