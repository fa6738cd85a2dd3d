"""Run registered queries against their SQL and report differences.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import all_oracles
from checks.queries import all_queries


TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
         "boolean": "BOOLEAN"}


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def _plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> str | None:
    """None if both sides agree, else what differs."""
    df = all_queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    left = sorted((tuple(_plain(v) for v in r) for r in df.select(*columns).collect()), key=_key)
    result = con.sql(all_oracles()[name])
    if sorted(result.columns) != columns:
        return f"columns {columns} against {sorted(result.columns)}"
    types = {c: TYPES.get(t, t) for c, t in df.dtypes}
    other = {c: str(t) for c, t in zip(result.columns, result.types)}
    if types != other:
        return f"types differ: {[(c, types[c], other[c]) for c in types if types[c] != other[c]]}"
    at = [result.columns.index(c) for c in columns]
    right = sorted((tuple(_plain(r[i]) for i in at) for r in result.fetchall()), key=_key)
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ, first {columns} {wrong[0]}"
    return None


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        table = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in argv[1:] or all_oracles():
        began = time.time()
        try:
            found = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failed += found is not None
        print(f"{name}: {found or 'ok'} ({time.time() - began:.1f} s)", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
