"""Plain Parquet tables: schema contract, additive change, staged rewrite, snapshots.

A table is a list of versions, each a numbered marker file that names its folders.  Rows go to a new folder, and only when
that is complete is the next marker made, if it is not there yet; a reader, or the job's own input, never sees a half-written
table, a lost executor or a failed run leaves the old version in place, and of two writers one is told.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.sources import commits

_MARKERS = "_versions"


class SchemaMismatch(ValueError):
    """A table does not have the columns its readers were written for."""


# ---------------------------------------------------------------------------------------------- schemas
def check_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame itself if names, order and types are the declared ones; else an error naming the difference."""
    have = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    want = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    if have != want:
        missing = [f"{n} {t}" for n, t in want if (n, t) not in have]
        extra = [f"{n} {t}" for n, t in have if (n, t) not in want]
        raise SchemaMismatch(f"missing {missing}, unexpected {extra}" if missing or extra else "columns out of order")
    return df


def add_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Additive migration: declared columns that are absent are added as NULL; nothing is dropped or retyped."""
    have = set(df.columns)
    new = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in have}
    return df.withColumns(new) if new else df


# ---------------------------------------------------------------------------------------------- folders
def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    named = named or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named


_MADE: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/hearthline/{name}-{uuid.uuid4().hex}"
    _MADE.add(path)
    return path


def remove_scratch(spark: SparkSession) -> None:
    """Remove every scratch folder this process has made, once no result that reads them is wanted any more."""
    for made in sorted(_MADE):
        path, fs = _hadoop_path(spark, made)
        fs.delete(path, True)
    _MADE.clear()


class Scratch:
    """Scratch tables of one run, for results that are used more than once.

    ``scratch(df, name)`` writes a frame and gives the same rows read back.  That cuts the plan, keeps a costly result
    (model answers above all) from being computed twice, and survives the loss of executors.
    """

    def __init__(self, spark: SparkSession, name: str = "run"):
        self.spark = spark
        self.root = scratch_path(spark, name)

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Remove the run's scratch tables once its results are stored."""
        path, fs = _hadoop_path(self.spark, self.root)
        fs.delete(path, True)
        _MADE.discard(self.root)


_hadoop_path = commits.hadoop_path


# ---------------------------------------------------------------------------------------------- versions
def versions(spark: SparkSession, root: str) -> list[tuple[int, list[str]]]:
    """Versions of a table, oldest first: number, and the folders that make it up."""
    path, fs = _hadoop_path(spark, f"{root}/{_MARKERS}")
    if not fs.exists(path):
        return []
    numbers = sorted(int(n) for n in (s.getPath().getName() for s in fs.listStatus(path)) if n.isdigit())
    return [(n, commits.read_text(spark, f"{root}/{_MARKERS}/{n:012d}").split()) for n in numbers]


def _current(spark: SparkSession, root: str) -> tuple[int, list[str]]:
    found = versions(spark, root)
    return found[-1] if found else (0, [])


def _next(df: DataFrame, root: str, old: int, kept: list[str]) -> None:
    """Write rows to a folder of a new name, then name it, and what is kept, in the version after ``old``."""
    spark, folder = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    if not commits.put_if_absent(spark, f"{root}/{_MARKERS}/{old + 1:012d}", "\n".join([*kept, folder])):
        path, fs = _hadoop_path(spark, f"{root}/{folder}")
        fs.delete(path, True)
        raise commits.Conflict(f"another writer has made version {old + 1} of {root}")


def rewrite(df: DataFrame, root: str) -> None:
    """Write a new version of a table and make it the current one.  ``df`` may read the table itself.

    What readers of an older version see stays as it is.  Of two writers that start from one version the later one fails.
    """
    _next(df, root, _current(df.sparkSession, root)[0], [])


def append(df: DataFrame, root: str) -> None:
    """Add rows: a new version of the folders of the current one and one more, so no reader meets half a write."""
    old, kept = _current(df.sparkSession, root)
    _next(df, root, old, kept)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, known as such when a plan is made: joins with them fall away, and no Python worker is started for them."""
    return spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields)).limit(0)


def _read(spark: SparkSession, root: str, schema: T.StructType, folders: list[str]) -> DataFrame:
    if not folders:
        return empty(spark, schema)
    return spark.read.schema(schema).parquet(*(f"{root}/{f}" for f in folders))


def read(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The current version of a table; an empty frame before the first one."""
    return _read(spark, root, schema, _current(spark, root)[1])


def snapshot(spark: SparkSession, root: str, stamp: str) -> None:
    """Name the current version, whose folders then stay; no row is copied.  A stamp is taken once."""
    if not commits.put_if_absent(spark, f"{root}/_snapshots/{stamp}", "\n".join(_current(spark, root)[1])):
        raise commits.Conflict(f"{root} has a snapshot {stamp} already")


def read_snapshot(spark: SparkSession, root: str, schema: T.StructType, stamp: str) -> DataFrame:
    return _read(spark, root, schema, commits.read_text(spark, f"{root}/_snapshots/{stamp}").split())


def forget(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Remove all but the newest ``keep`` versions; folders that a kept version or a snapshot names stay."""
    found = versions(spark, root)
    path, fs = _hadoop_path(spark, f"{root}/_snapshots")
    stamps = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    named = {f for _, fs_ in found[-keep:] for f in fs_}
    named |= {f for s in stamps if not s.startswith(".") for f in commits.read_text(spark, f"{root}/_snapshots/{s}").split()}
    for number, folders in found[:-keep]:
        for where in (f"{_MARKERS}/{number:012d}", *(f for f in folders if f not in named)):
            fs.delete(_hadoop_path(spark, f"{root}/{where}")[0], True)


def clear(spark: SparkSession, root: str, schema: T.StructType) -> None:
    """Remove all rows, keep the table and its schema."""
    rewrite(spark.createDataFrame([], schema), root)
