"""Compare named queries with their SQL in the checking engine: python tests/check_tool.py [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_cell(r[k]) for k in order) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, df.collect())


def check_rows(con, sql):
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    return columns, rows_of(columns, found.fetchall())


def compare(spark, con, folder, name, fn, sql):
    df = fn(spark, folder)
    ours = spark_rows(df)
    columns, theirs = check_rows(con, sql)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if ours != theirs:
        extra = sorted(set(ours) - set(theirs))[:2]
        missing = sorted(set(theirs) - set(ours))[:2]
        return f"rows {len(ours)} vs {len(theirs)}\n   spark only {extra}\n   check only {missing}"
    return f"ok {len(ours)}" if ours else "ok but empty"


if __name__ == "__main__":
    from tests.conftest import make_session
    import __spark_entry__ as e
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = make_session()
    con = connect(folder)
    checks, wanted = e.oracle_sql(), sys.argv[1:]
    for name, fn in e.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            verdict = compare(spark, con, folder, name, fn, checks[name]) if name in checks else \
                f"no check, {fn(spark, folder).count()} rows"
        except Exception as problem:
            verdict = f"FAILED {type(problem).__name__}: {str(problem)[:700]}"
        print(f"{name}: {verdict} [{time.time() - start:.1f}s]", flush=True)
