"""Run every query in Spark and its SQL in DuckDB, and compare the rows.

    python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from decimal import Decimal

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, Decimal):
        return float(value)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    found = [tuple(cell(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(found, key=repr)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def type_gaps(spark_df, con, sql: str):
    """Columns whose declared types differ between the engines."""
    kinds = {name: kind for name, kind, *_ in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [(n, kind, kinds.get(n)) for n, kind in spark_df.dtypes if TYPES.get(kind) != kinds.get(n)]


def compare(spark_df, con, sql: str):
    """None when both sides agree, else a short description."""
    rows = spark_df.collect()
    result = con.execute(sql)
    names = [item[0] for item in result.description]
    left = table(spark_df.columns, rows)
    right = table(names, result.fetchall())
    if left[0] != right[0]:
        return f"columns {set(left[0]) ^ set(right[0])}", len(rows)
    if len(left[1]) != len(right[1]):
        return f"row counts {len(left[1])} and {len(right[1])}", len(rows)
    for a, b in zip(left[1], right[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"first difference\n   spark  {a}\n   duckdb {b}", len(rows)
    return None, len(rows)


def main():
    import __spark_entry__ as entry
    from tests.conftest import make_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = make_session()
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = []
    for key in args[1:] or queries:
        start = time.time()
        try:
            frame = queries[key](spark, sf_dir)
            if key in sqls:
                con = connect(sf_dir)
                problem, n = compare(frame, con, sqls[key])
                gaps = type_gaps(frame, con, sqls[key])
                if gaps:
                    print(f"     types of {key}: {gaps}")
            else:
                problem, n = None, len(frame.collect())
        except Exception as error:  # report and go on with the next key
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", 0
        if problem:
            failed.append(key)
        kind = "sql" if key in sqls else "rows only"
        print(f"{'FAIL' if problem else 'ok  '} {key} [{kind}] rows={n} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(failed)} failed: {failed}; unmatched SQL keys: {sorted(set(sqls) - set(queries))}")


if __name__ == "__main__":
    main()
