"""Compare registered queries with their SQL twins: ``python tests/oracle_check.py [sf_dir] [name …]``."""

from __future__ import annotations

import datetime as dt
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
# Spark type name -> acceptable type of the other engine.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "double": "DOUBLE"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def compare(spark, con, query, sql: str, sf_dir: str) -> list[str]:
    """Differences between a query and its twin; empty if they agree."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=_key)
    cur = con.execute(sql)
    described = [(d[0], str(d[1])) for d in cur.description]
    order = sorted(range(len(described)), key=lambda i: described[i][0])
    want = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=_key)
    problems = []
    if names != [described[i][0] for i in order]:
        return [f"columns {names} != {[described[i][0] for i in order]}"]
    types = dict(df.dtypes)
    for i in order:
        name, theirs = described[i]
        if TYPES.get(types[name], types[name]) != theirs:
            problems.append(f"type of {name}: {types[name]} vs {theirs}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    fix = lambda v: v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v
    bad = [(a, b) for a, b in zip(got, want) if tuple(map(fix, a)) != tuple(map(fix, b))]
    if bad:
        problems.append(f"{len(bad)} rows differ, first: {str(bad[0][0])[:300]} vs {str(bad[0][1])[:300]}")
    if not got:
        problems.append("no rows")
    return problems


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        begun = time.time()
        try:
            problems = compare(spark, con, query, oracles[name], sf_dir) if name in oracles else [f"no twin, {query(spark, sf_dir).count()} rows"]
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:700]}"]
        failed += bool(problems)
        print(f"{'ok ' if not problems else 'BAD'} {name} {time.time() - begun:.1f}s {' | '.join(problems)}", flush=True)
    print(f"{failed} with problems")
    return failed


if __name__ == "__main__":
    sys.exit(main())
