"""Run a query on Spark and its SQL on DuckDB and compare the results as sorted rows.

``python -m tests.compare <sf dir> [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(int(v)))
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (1, repr(round(v, 9) + 0.0))
    if isinstance(v, int):
        return (1, str(v))
    if isinstance(v, datetime.datetime):
        return (1, v.isoformat())
    return (1, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
         "boolean": "BOOLEAN"}


def compare(df, con, sql):
    """Empty string when equal, otherwise the first difference."""
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    kinds = {d[0]: str(d[1]) for d in res.description}
    want = res.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    for f in df.schema.fields:
        kind = KINDS.get(f.dataType.simpleString(), f.dataType.simpleString())
        if kind != kinds[f.name]:
            return f"type of {f.name}: {kind} != {kinds[f.name]}"
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{x} != {y}"
    return "" if a else "no rows"


def main():
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from cohortloom.session import get_spark

    sf, names = sys.argv[1], sys.argv[2:]
    spark = get_spark(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con, q, o = connect(sf), e.queries(), e.oracle_sql()
    bad = 0
    for name in names or q:
        start = time.time()
        try:
            df = q[name](spark, sf)
            verdict = compare(df, con, o[name]) if name in o else f"rows only: {len(df.collect())}"
        except Exception as ex:  # noqa: BLE001
            verdict = f"ERROR {type(ex).__name__}: {str(ex)[:600]}"
        bad += bool(verdict) and not verdict.startswith("rows only")
        print(f"{time.time() - start:6.2f}s {name}: {verdict or 'ok'}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
