"""Compare the catalogue with its SQL: ``python -m tests.oracle SF_DIR [name ...]``."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    """One form for values the two engines return in different Python types."""
    if isinstance(value, Decimal):
        return str(value.normalize())
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def compare(df, con, sql: str) -> str | None:
    """None when both results hold the same rows under the same column names."""
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} instead of {sorted(names)}"
    order = [names.index(c) for c in columns]
    wanted = Counter(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())
    if rows == wanted:
        return None if rows else "both results are empty"
    extra, missing = list((rows - wanted).items())[:2], list((wanted - rows).items())[:2]
    return f"{sum(rows.values())} rows instead of {sum(wanted.values())}; extra {extra}; missing {missing}"[:1500]


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from etlspec.catalogue import CATALOGUE

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(CATALOGUE)
    spark, con, failed = session(), connect(sys.argv[1]), []
    for name in names:
        started = time.perf_counter()
        try:
            query = CATALOGUE[name]
            df = query.run(spark, sf_dir)
            problem = compare(df, con, query.sql) if query.sql else (None if df.count() else "no rows")
        except Exception as exc:  # report all queries
            problem = f"{type(exc).__name__}: {str(exc)[:1200]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.perf_counter() - started:.2f}s {problem or ''}", flush=True)
        if problem is not None:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} match", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
