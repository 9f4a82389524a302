"""Run the registered queries against their SQL twins in DuckDB.

    python -m tests.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def difference(df, con, sql) -> str | None:
    """None when schema, row count and every value agree, else what does not."""
    result = con.sql(sql)
    types = {n: str(t) for n, t in zip(result.columns, result.types)}
    want = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
            "date": "DATE", "boolean": "BOOLEAN"}
    ours = {n: want[t] for n, t in df.dtypes}
    if ours != types:
        return f"schema {ours} against {types}"
    names = sorted(ours)
    order = [result.columns.index(n) for n in names]
    theirs = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=_key)
    mine = sorted((tuple(r[n] for n in names) for r in df.collect()), key=_key)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{dict(zip(names, a))} against {dict(zip(names, b))}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parents[1]))
    import __spark_entry__ as e
    from tests.conftest import session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con, sql = session(), duck(sf), e.oracle_sql()
    for name, query in e.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            df = query(spark, sf)
            if name in sql:
                bad = difference(df, con, sql[name])
                state = "same" if bad is None else f"DIFFERENT {bad}"
            else:
                state = f"{len(df.collect())} rows, no twin"
        except Exception as x:
            state = f"ERROR {str(x)[:1500]}"
        print(f"{name:32} {time.time() - t:6.2f}s {state}", flush=True)
