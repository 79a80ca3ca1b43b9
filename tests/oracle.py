"""Compare catalogue queries with their oracle SQL in DuckDB.

Run as a script: ``python tests/oracle.py <sf_dir> [name ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from concordat.plans.base import TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, cell(v)) for k, v in value.items()))
    return value


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, query, sql):
    """Empty text when equal, else the first difference."""
    df = query(spark, sf_dir)
    mine = normal_rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    theirs = normal_rows(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{sorted(columns)}\n   spark {a}\n   duck  {b}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR"}
    odd = [(n, k, types[n]) for n, k in df.dtypes if kinds.get(k, types[n]) != types[n]]
    return f"types {odd}" if odd else ""


def main(sf_dir, names):
    import __spark_entry__ as entry
    from concordat.session import get_session

    spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not names or any(n.startswith(x) for x in names)]
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            if name in oracle:
                problem = compare(spark, con, sf_dir, queries[name], oracle[name])
            else:
                problem = "" if queries[name](spark, sf_dir).count() > 0 else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem[:2500]}", flush=True)
    print(f"{len(chosen) - bad}/{len(chosen)} ok")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
