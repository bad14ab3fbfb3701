"""Runs a query on Spark and its SQL on DuckDB over the same files and compares.

Use as a script: ``python tests/oracle.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [tuple("NULL" if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)) else repr(v.item() if hasattr(v, "item") else v) for v in row)
            for row in df.itertuples(index=False, name=None)]
    return sorted(rows)


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: str(t) for c, t in sorted(df.dtypes.items())}


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str | None:
    """None if equal, else the first difference."""
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return f"rows {len(spark_pdf)} vs {len(duck_pdf)}"
    if len(spark_pdf) == 0:
        return "no rows"
    a, b = canonical(spark_pdf), canonical(duck_pdf)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ; columns {sorted(spark_pdf.columns)}\n   spark {bad[0][0]}\n   duck  {bad[0][1]}\n   types {kinds(spark_pdf)}\n         {kinds(duck_pdf)}"
    if kinds(spark_pdf) != kinds(duck_pdf):
        ks, kd = kinds(spark_pdf), kinds(duck_pdf)
        return f"types differ: { {c: (ks[c], kd[c]) for c in ks if ks[c] != kd[c]} }"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as e
    from skydrift.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracle = e.queries(), e.oracle_sql()
    names = argv[1:] or list(queries)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf), []
    for n in names:
        t0 = time.time()
        try:
            got = queries[n](spark, sf).toPandas()
            t1 = time.time()
            if n not in oracle:
                msg = None if len(got) else "no rows"
                note = f"rows only ({len(got)})"
            else:
                msg = compare(got, con.execute(oracle[n]).df())
                note = f"{len(got)} rows"
        except Exception as ex:  # noqa: BLE001
            t1, msg, note = time.time(), f"{type(ex).__name__}: {str(ex)[:600]}", ""
        print(f"{'ok  ' if msg is None else 'FAIL'} {n:34s} spark {t1 - t0:6.2f}s duck {time.time() - t1:6.2f}s {note}", flush=True)
        if msg:
            failed.append(n)
            print("   ", msg, flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} fine; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
