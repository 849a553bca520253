"""Runs queries next to their checking SQL: python tests/oracle.py [sf] [query ...]"""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return db


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


def compare(spark, db, sf_dir, name):
    """None if both sides agree, else a short account of the difference."""
    df = entry.queries()[name](spark, sf_dir)
    got = normal(df.collect(), df.columns)
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    want = normal(result.fetchall(), columns)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got == want:
        return None if got else "no rows"
    extra, missing = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
    return f"rows {len(got)} vs {len(want)}; only spark {extra}; only sql {missing}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "8g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    database = connect(sf_dir)
    for query in sys.argv[2:] or entry.queries():
        started = time.time()
        try:
            problem = compare(session, database, sf_dir, query)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{query:28s} {time.time() - started:6.2f}s", "ok" if problem is None else problem, flush=True)
