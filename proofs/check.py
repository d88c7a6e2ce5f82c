"""Run queries and their SQL side by side and compare every value.

    python -m proofs.check /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

from canvass.session import build_session
from proofs.oracle import oracle_sql
from proofs.queries import queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _bag(rows, names: list[str]) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a Spark result and a SQL result; empty if nothing does."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    theirs = _bag(result.fetchall(), names)
    ours = _bag(df.collect(), df.columns)
    found = []
    if sum(ours.values()) != sum(theirs.values()):
        found.append(f"rows {sum(ours.values())} against {sum(theirs.values())}")
    found += [f"only Spark {r}" for r in list((ours - theirs))[:3]]
    found += [f"only SQL   {r}" for r in list((theirs - ours))[:3]]
    return found


def main(folder: str, *names: str) -> int:
    spark: SparkSession = build_session("check", "local[8]", spark__sql__shuffle__partitions="8",
                                        spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(folder), oracle_sql(), 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            found = differences(run(spark, folder), con, oracles[name])
        except Exception:
            found = traceback.format_exc().strip().splitlines()[-6:]
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.2f}s", flush=True)
        for line in found:
            print("     ", line[:600])
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
