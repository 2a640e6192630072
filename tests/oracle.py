"""Local Spark-vs-DuckDB comparison of the registered queries (developer tool).

    python -m tests.oracle [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

from penprint.tables import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA:
        return "null"
    if isinstance(v, float):
        if math.isnan(v):
            return "null"  # pandas shows a null of a numeric column as nan
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return sorted((tuple(_norm(r[c]) for c in cols) for _, r in pdf.iterrows()), key=repr), cols


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "float": "FLOAT", "boolean": "BOOLEAN", "array<int>": "INTEGER[]", "array<string>": "VARCHAR[]",
                 "array<bigint>": "BIGINT[]", "array<array<int>>": "INTEGER[][]", "array<double>": "DOUBLE[]"}


def type_mismatches(sdf, rel) -> list:
    duck_types = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    out = []
    for f in sdf.schema.fields:
        want = SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
        got = duck_types.get(f.name)
        if got is not None and got != want:
            out.append((f.name, f.dataType.simpleString(), got))
    return out


def compare(spark, sf_dir: str, name: str, fn, sql: str, con=None) -> tuple[bool, str]:
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    sp = sdf.toPandas()
    t1 = time.time()
    rel = con.sql(sql)
    tm = type_mismatches(sdf, rel)
    dd = rel.fetchdf()
    t2 = time.time()
    if tm:
        return False, f"type mismatch {tm}"
    a, ca = rows_of(sp)
    b, cb = rows_of(dd)
    if ca != cb:
        return False, f"columns differ: {ca} vs {cb}"
    if len(a) != len(b):
        return False, f"row count {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} rows differ, e.g. {bad[0]}"
    return True, f"{len(a)} rows ok (spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s)"


def main(argv):
    from penprint.plans.registry import load_all
    from penprint.session import get_spark
    sf = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    reg = load_all()
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    con = duck(sf)
    fails = 0
    for name, (fn, sql) in reg.items():
        if names and name not in names:
            continue
        if sql is None:
            t0 = time.time()
            n = fn(spark, sf).count()
            print(f"ROWS {name}: {n} rows ({time.time() - t0:.1f}s)", flush=True)
            continue
        try:
            ok, msg = compare(spark, sf, name, fn, sql, con)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"error {type(e).__name__}: {str(e)[:400]}"
        fails += not ok
        print(f"{'PASS' if ok else 'FAIL'} {name}: {msg}", flush=True)
    print(f"failures: {fails}")
    return fails


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
