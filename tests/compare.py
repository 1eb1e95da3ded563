"""Run registered queries and compare them with DuckDB on the same tables.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return db


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    out = {}
    for c in df.columns:
        s = df[c]
        kind = "f" if s.dtype.kind in "fiub" and s.isna().any() else s.dtype.kind
        if kind == "f":
            out[c] = s.astype(float)
        else:
            out[c] = s
    df = pd.DataFrame(out)
    if len(df.columns):
        df = df.sort_values(list(df.columns), key=lambda s: s.astype(str)).reset_index(drop=True)
    return df


def differences(spark_df, db, sql: str) -> str | None:
    """None when equal, else what differs."""
    got, want = spark_df.toPandas(), db.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} against {len(want)}"
    types = {f.name: f.dataType.simpleString() for f in spark_df.schema}
    kinds = {n: str(t) for n, t in zip(want.columns, [d[1] for d in db.execute(sql).description])}
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for c, t in types.items():
        if names.get(t, t) != kinds[c] and t in names:
            return f"type of {c}: {t} against {kinds[c]}"
    a, b = canonical(got), canonical(want)
    for c in a.columns:
        left, right = a[c], b[c]
        same = (left == right) | (left.isna() & right.isna())
        if not same.all():
            i = int((~same).to_numpy().argmax())
            return f"{(~same).sum()} values of {c}, first {left[i]!r} against {right[i]!r}"
    return None


def main() -> int:
    from panelforge.catalog import REGISTRY
    from panelforge.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTRY)
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    bad = 0
    for name in names:
        q = REGISTRY[name]
        start = time.time()
        try:
            df = q.run(spark, folder)
            if q.sql:
                found = differences(df, db, q.sql)
            else:
                found = None if df.count() > 0 else "no rows"
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e)[:600]}"
        bad += found is not None
        kind = "sql" if q.sql else "rows"
        print(f"{'ok  ' if found is None else 'FAIL'} {kind:4} {name:32} {time.time() - start:6.2f}s {found or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
