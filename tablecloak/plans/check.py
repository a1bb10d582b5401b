"""Run registered queries next to their DuckDB SQL and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from tablecloak.plans.registry import ORACLES, QUERIES
from tablecloak.plans.views import BASE


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, float):
        return repr(round(x, 6))
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(_cell(i) for i in x) + "]"
    return str(x)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def compare(spark: SparkSession, sf: str, name: str, con=None) -> str:
    """`ok`, `rows` (no SQL given) or what differs."""
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return f"rows {len(got)}"
    cur = (con or duck(sf)).execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"row count {len(got)} != {len(want)}"
    a, b = _rows(df.columns, got), _rows(columns, want)
    for x, y in zip(a, b):
        if x != y:
            return f"first difference {x} != {y}"[:600]
    ours = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    theirs = {d[0]: str(d[1]) for d in cur.description}
    return "ok" + _types(ours, theirs)


def _types(ours: dict, theirs: dict) -> str:
    same = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
            "boolean": "BOOLEAN"}
    odd = [f"{k}:{t}/{theirs[k]}" for k, t in ours.items()
           if same.get(t) != theirs[k].upper() and not theirs[k].startswith('"')]
    return " types " + ",".join(odd) if odd else ""


def main(argv: list[str]) -> int:
    import tablecloak.plans.queries  # noqa: F401
    from tablecloak.session import build_session

    sf, pattern = argv[0], argv[1:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                  "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf), 0
    for name in QUERIES:
        if pattern and not any(name.startswith(p) for p in pattern):
            continue
        start = time.time()
        try:
            result = compare(spark, sf, name, con)
        except Exception as e:
            result = "ERROR " + str(e)[:900]
        bad += not result.startswith(("ok", "rows"))
        print(f"{time.time() - start:6.2f}s {name}: {result}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
