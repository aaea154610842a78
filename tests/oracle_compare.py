"""Side-by-side check of registered Spark queries against their DuckDB oracles.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Prints one line per query: name, match flags, row counts.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
from collections import Counter

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return norm(v.item())
        except Exception:
            pass
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in records)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as se
    qs, sqls = se.queries(), se.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in sorted(names or qs):
        df = qs[name](spark, sf_dir)
        s_cols = df.columns
        s_rows = [tuple(r) for r in df.collect()]
        res = {"spark_rows": len(s_rows)}
        if name in sqls:
            cur = con.execute(sqls[name])
            d_cols = [d[0] for d in cur.description]
            d_rows = cur.fetchall()
            res.update(oracle_rows=len(d_rows), schema=sorted(s_cols) == sorted(d_cols),
                       values=rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows) if sorted(s_cols) == sorted(d_cols) else False)
            if verbose and not res["values"]:
                a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
                print("  spark-only:", list((a - b).items())[:3])
                print("  oracle-only:", list((b - a).items())[:3])
                if not res["schema"]:
                    print("  cols:", sorted(s_cols), sorted(d_cols))
        results[name] = res
        if verbose:
            print(name, res, flush=True)
    return results


if __name__ == "__main__":
    from pyspark.sql import SparkSession
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    out = compare(spark, sf, names)
    bad = [k for k, v in out.items() if "values" in v and not (v["values"] and v["schema"]
                                                                and v["spark_rows"] == v["oracle_rows"])]
    print("MISMATCH:", bad)
    print(f"checked {sum('values' in v for v in out.values())} with oracle, {len(out)} total")
