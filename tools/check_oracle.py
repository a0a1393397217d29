"""Compare every registered query with its DuckDB form.

usage: python tools/check_oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from modelsieve.plans.oracle import ORACLE  # noqa: E402
from modelsieve.plans.registry import QUERIES  # noqa: E402
from modelsieve.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canon(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() else repr(value)
    if isinstance(value, pd.Timestamp):
        return value.tz_localize(None).isoformat()
    return str(value)


SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
             "timestamp": "TIMESTAMP"}


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(tuple(canon(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


def compare(spark, con, name: str, sf_dir: str) -> str:
    begin = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = df.toPandas()
    spent = time.time() - begin
    if name not in ORACLE:
        return f"rows-only {len(got):8d} rows {spent:6.1f}s"
    want = con.execute(ORACLE[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} vs {sorted(want.columns)}"
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {ORACLE[name]}").fetchall()}
    kinds = [(f.name, f.dataType.simpleString(), types[f.name]) for f in df.schema
             if SAME_TYPE.get(f.dataType.simpleString()) != types[f.name]]
    a, b = rows_of(got), rows_of(want)
    if a != b:
        only_a, only_b = set(a) - set(b), set(b) - set(a)
        return (f"MISMATCH rows {len(a)} vs {len(b)}; columns {sorted(got.columns)}\n   spark  {sorted(only_a)[:3]}"
                f"\n   duckdb {sorted(only_b)[:3]}")
    note = f" TYPES {kinds}" if kinds else ""
    return f"ok {len(a):8d} rows {spent:6.1f}s{note}"


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name in names:
        try:
            verdict = compare(spark, con, name, sf_dir)
        except Exception as exc:
            verdict = "ERROR " + str(exc)[:600].replace("\n", " ")
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{name:28s} {verdict}", flush=True)
    print("without oracle:", sorted(set(QUERIES) - set(ORACLE)), "| unused:", sorted(set(ORACLE) - set(QUERIES)))
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
