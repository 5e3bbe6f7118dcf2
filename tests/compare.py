"""Runs a query in Spark and its SQL in DuckDB and compares rows, names and values."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


KIND = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def compare(df, con, sql: str) -> list[str]:
    problems = []
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    con.execute(sql)
    names = [d[0] for d in con.description]
    kinds = {d[0]: str(d[1]) for d in con.description}
    rows = con.fetchall()
    if sorted(names) != cols:
        return [f"columns {cols} != {sorted(names)}"]
    for name, kind in df.dtypes:
        if kinds[name] in KIND and KIND[kinds[name]] != kind:
            problems.append(f"type of {name}: {kind} != {kinds[name]}")
    at = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in at) for r in rows]
    if not got:
        problems.append("no rows")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    a, b = Counter(got), Counter(want)
    if a != b:
        near = sorted(((a - b).elements()), key=repr)[:3], sorted(((b - a).elements()), key=repr)[:3]
        problems.append(f"values differ in {sum((a - b).values())} rows of {cols}: spark {near[0]} sql {near[1]}")
    return problems


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", "8"))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = duck(sf), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if argv and not any(a in name for a in argv):
            continue
        begin = time.time()
        try:
            df = query(spark, sf)
            problems = compare(df, con, oracle[name]) if name in oracle else [] if df.count() else ["no rows"]
        except Exception as exc:  # noqa: BLE001
            problems = [str(exc)[:1500]]
        took = time.time() - begin
        print(f"{'ok ' if not problems else 'BAD'} {name} {took:.1f}s{'' if name in oracle else ' (rows only)'}", flush=True)
        for p in problems:
            bad += 1
            print("     ", p, flush=True)
    print("problems:", bad)
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
