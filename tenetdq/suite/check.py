"""Side-by-side check of the registered queries against DuckDB on the same files."""
from __future__ import annotations

import glob
import math
import os
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def table_rows(columns, rows):
    """Rows as sorted tuples of text, columns ordered by name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, name, fn, sql, sf_dir):
    """(ok, message, seconds)."""
    start = time.time()
    df = fn(spark, sf_dir)
    got_rows = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if sql is None:
        return True, f"{len(got_rows)} rows (no SQL)", spent
    cur = oracle_connection(sf_dir).execute(sql)
    want_cols = [d[0] for d in cur.description]
    want_types = [str(d[1]) for d in cur.description]
    gc, gr = table_rows(df.columns, got_rows)
    wc, wr = table_rows(want_cols, cur.fetchall())
    types = dict(df.dtypes)
    kind = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "INTEGER": "int"}
    if gc != wc:
        return False, f"columns {gc} != {wc}", spent
    bad = [(c, types[c], t) for c, t in zip(want_cols, want_types) if kind.get(t, t) != types[c]]
    if bad:
        return False, f"types {bad}", spent
    if gr != wr:
        extra = sorted(set(gr) - set(wr))[:3]
        missing = sorted(set(wr) - set(gr))[:3]
        return False, f"rows {len(gr)} vs {len(wr)}; only spark {extra}; only sql {missing}", spent
    return True, f"{len(gr)} rows", spent


def main(argv=None):
    import argparse
    from tenetdq.session import build_session
    from tenetdq.suite import ORACLES, QUERIES
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--dir", default=os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01"))
    args = ap.parse_args(argv)
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    failed = []
    for name in args.names or QUERIES:
        try:
            ok, msg, s = compare(spark, name, QUERIES[name], ORACLES.get(name), args.dir)
        except Exception as exc:
            ok, msg, s = False, f"{type(exc).__name__}: {str(exc)[:1500]}", 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {name:34} {s:6.2f}s  {msg}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
