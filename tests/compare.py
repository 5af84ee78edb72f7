"""Run registered queries beside their SQL counterpart: python tests/compare.py [-d SF] NAME..."""

import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
import duckdb
import pandas as pd

import __spark_entry__ as entry


def canon(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA else str(bool(v)))
        elif pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].map(lambda v: None if pd.isna(v) else f"{v:.6g}")
        elif pd.api.types.is_integer_dtype(df[c]):
            df[c] = df[c].map(lambda v: None if pd.isna(v) else f"{v:.6g}" if False else str(int(v)))
        else:
            df[c] = df[c].map(lambda v: None if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else str(list(v)) if hasattr(v, "tolist") or isinstance(v, list) else str(v))
    return sorted(map(tuple, df.where(df.notna(), None).astype(object).itertuples(index=False)), key=str)


def views(folder):
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from read_parquet('{folder}/{f}')")
    return con


def same(spark, con, folder, name):
    t = time.time()
    got = entry.queries()[name](spark, folder).toPandas()
    took, t = time.time() - t, time.time()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None, len(got), -1, took, 0, None
    want = con.execute(sql).df()
    cols = sorted(got.columns) == sorted(want.columns)
    a, b = canon(got), canon(want)
    diff = None if cols and a == b else (sorted(got.columns), sorted(want.columns)) if not cols else ([x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]) if len(a) < 100000 else "large"
    return cols and a == b, len(a), len(b), took, time.time() - t, diff


if __name__ == "__main__":
    from edgewright.session import local_session

    args = sys.argv[1:]
    sf = "sf0.01"
    if args[:1] == ["-d"]:
        sf, args = args[1], args[2:]
    folder = f"/root/testdata/{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = views(folder)
    skip = set(a[1:] for a in args if a.startswith("!"))
    args = [a for a in args if not a.startswith("!")]
    names = [n for n in entry.queries() if n not in skip and not (not args and n[0] == "p" and n[1].isdigit())] if not args else [n for n in entry.queries() if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    for n in names:
        try:
            ok, a, b, s, t, diff = same(spark, con, folder, n)
            print("OK  " if ok else "ROWS" if ok is None else "DIFF", n, a, b, f"{s:.1f}s {t:.1f}s", diff or "", flush=True)
        except Exception as e:  # noqa: BLE001
            print("FAIL", n, str(e)[:600], flush=True)
