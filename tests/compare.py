"""Run registered queries in Spark and their statements in DuckDB and compare the rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def differences(spark: SparkSession, con, run, sql: str, sf_dir: str) -> list[str]:
    """What differs; nothing when the two agree."""
    df = run(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    out = []
    if sorted(df.columns) != sorted(columns):
        out.append(f"columns {sorted(df.columns)} and {sorted(columns)}")
    if len(ours) != len(theirs):
        out.append(f"{len(ours)} rows and {len(theirs)}")
    out += [f"{a}\n   {b}" for a, b in zip(ours, theirs) if a != b][:3]
    return out


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from emberlog.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if (names and name not in names) or name not in oracles:
            continue
        start = time.time()
        try:
            diff = differences(spark, con, run, oracles[name], sf_dir)
        except Exception as e:
            diff = [f"{type(e).__name__}: {str(e)[:1500]}"]
        print(f"{'ok ' if not diff else 'BAD'} {name} {time.time() - start:.1f}s", flush=True)
        for line in diff:
            print("   ", line[:1500])
        bad += bool(diff)
    print("bad:", bad)


if __name__ == "__main__":
    main()
