"""Compare registered queries with their SQL: ``python tests/check_oracles.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as registry  # noqa: E402
from hearthline.sources import tables  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def spark_session(cores: str = "8"):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hearthline")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return "" if value is None else f"{type(value).__name__[:3]}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, look=None) -> tuple[bool, str]:
    """Whether a query and its SQL agree, and a line that says so; ``look`` gets the query's frame as well."""
    start = time.time()
    df = registry.queries()[name](spark, sf_dir)
    if look is not None:
        look(df)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return True, f"{name}: {len(got)} rows, no SQL, {took:.1f}s"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} but SQL has {sorted(columns)}"
    if got != want:
        extra, lost = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        return False, (
            f"{name}: {len(got)} rows against {len(want)}; only Spark {len(extra)}, only SQL {len(lost)}\n"
            f"   {sorted(columns)}\n   spark {extra[:4]}\n   sql   {lost[:4]}"
        )
    return True, f"{name}: {len(got)} rows equal, {took:.1f}s"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(registry.queries())
    spark, con, bad = spark_session(), duck(sf_dir), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        try:
            ok, line = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            ok, line = False, f"{name}: {type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + line, flush=True)
    tables.remove_scratch(spark)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
