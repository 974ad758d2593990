"""Run registered queries against DuckDB:  python tests/compare.py [--sf sf0.01] [name ...]"""

import datetime as dt
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
DATA = os.environ.get("TESTDATA", "/root/testdata")


def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(str(plain(r[i])) for i in order) for r in rows)


def compare(spark, folder, name, con=None):
    """(rows, problem or None) for one query."""
    from civicledger.plans.oracles import ORACLES
    from civicledger.plans.queries import QUERIES

    df = QUERIES[name](spark, folder)
    cols, got = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        return sum(got.values()), None if got else "no rows"
    cur = (con or duck(folder)).execute(ORACLES[name])
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != want_cols:
        return sum(got.values()), f"columns {cols} != {want_cols}"
    if got != want:
        extra, missing = got - want, want - got
        return sum(got.values()), (
            f"{sum(extra.values())} rows only in Spark, {sum(missing.values())} only in SQL (of {sum(want.values())})\n   {cols}"
            + "".join(f"\n   + {r}" for r in sorted(extra)[:4]) + "".join(f"\n   - {r}" for r in sorted(missing)[:4]))
    return sum(got.values()), None


def main(argv):
    from civicledger.plans.queries import QUERIES
    from civicledger.session import build_session

    sf = "sf0.001"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 12g pyspark-shell")
    spark = build_session("compare", os.environ.get("COMPARE_MASTER", "local[8]"), 8)
    spark.sparkContext.setLogLevel("ERROR")
    folder, con, bad = f"{DATA}/{sf}", duck(f"{DATA}/{sf}"), 0
    for name in argv or QUERIES:
        start = time.time()
        try:
            n, problem = compare(spark, folder, name, con)
        except Exception as e:  # keep going, report all
            n, problem = 0, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:40s} {n:8d} rows {time.time() - start:6.1f}s {problem or ''}", flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main(sys.argv[1:])
