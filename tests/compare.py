"""Side-by-side run of registered queries in Spark and DuckDB."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    if hasattr(value, "as_tuple"):
        return f"{float(value):.6f}" if value != int(value) else str(int(value))
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str, queries, sql) -> str:
    df = queries[name](spark, sf_dir)
    got = df.collect()
    if name not in sql:
        return f"rows only ({len(got)})"
    cur = con.execute(sql[name])
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"MISMATCH columns {sorted(df.columns)} / {sorted(cols)}"
    a, b = canonical(df.columns, got), canonical(cols, want)
    if a != b:
        only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"MISMATCH {len(a)} / {len(b)} rows, {only}"
    return f"ok ({len(a)})"


def main() -> None:
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from readloom.session import build_session

    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(queries())
    spark, con = build_session(), connect(sf_dir)
    for name in names:
        start = time.time()
        try:
            result = compare(spark, con, sf_dir, name, queries(), oracle_sql())
        except Exception as e:  # noqa: BLE001
            result = "ERROR " + str(e)[:600]
        print(f"{name:24s} {time.time() - start:6.2f}s {result}", flush=True)


if __name__ == "__main__":
    main()
