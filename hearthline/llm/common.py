"""What several operators of this subpackage need: written intermediate tables, packed text, components, shared files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.sources.tables import Scratch


class Work(Scratch):
    """Intermediate tables of one operator call, written to the folder all executors share.

    ``put`` writes a frame and returns it as read back, which cuts the lineage; ``free`` removes a table as soon as its
    reader's own result is written.
    """

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(spark, f"llm-{name}")
        self._tables: list[tuple[DataFrame, str]] = []

    def put(self, df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
        """``batch_rows``: at most so many rows at a time go to this write's Python workers."""
        path, limit = f"{self.root}/{name}-{uuid.uuid4().hex}", "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(limit)
        if batch_rows:
            self.spark.conf.set(limit, str(batch_rows))
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(limit, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._tables.append((out, path))
        return out

    def free(self, *frames: DataFrame) -> None:
        for _, path in (t for t in self._tables if any(t[0] is f for f in frames)):
            self.remove(path.rsplit("/", 1)[1])
        self._tables = [t for t in self._tables if not any(t[0] is f for f in frames)]


    def remove(self, name: str) -> None:
        """Remove a file or folder of this call."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def task_id() -> int:
    return TaskContext.get().partitionId()


def offsets_by_task(counts: DataFrame, by: list[str]) -> DataFrame:
    """``counts`` has ``by``, ``task`` and ``n``; adds ``base``: the rows of the group in tasks before this one.

    One row per task and group, so the window is over as many rows as there are tasks.
    """
    from pyspark.sql import Window

    window = Window.partitionBy(*by).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("base", F.coalesce(F.sum("n").over(window), F.lit(0)))


# ------------------------------------------------------------------------------------------------ components
def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning stars of a task's edges: at most one row per node that the task has seen."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, r) for x in list(parent) if (r := find(x)) != x]
    for at in range(0, len(rows), 100_000):
        part = rows[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64())], ["a", "b"])


def components(edges: DataFrame, work: Work) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a``, ``b`` long): the smallest node it can reach.

    Edges of a task are first reduced to its spanning stars.  Then large-star and small-star steps alternate until no
    edge changes, about log n rounds; each round is a map-side combined minimum and a join, and is written.
    """
    pairs = edges.where("a <> b").select("a", "b").mapInArrow(_forest, "a long, b long").distinct()
    pairs = work.put(pairs, "edges")
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Minima are written before they are joined, so that Spark can split the join at a node with many edges.
        low = work.put(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = work.put(large.distinct(), "large")
        work.free(low)
        low = work.put(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        joined = large.join(low, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        small = work.put(small.distinct(), "small")
        new = tuple(small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        work.free(large, low, pairs)
        pairs = small
        if new == state:
            break
        state = new
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


# ------------------------------------------------------------------------------------------------ shared files
def open_folder(uri: str):
    """File system and path of a shared folder, from within a task; by its URI, so object stores work as well."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_once(uri: str, name: str, blocks: Iterator[bytes]) -> tuple[str, int]:
    """Write a file under a name of this attempt; a repeated or speculative task never touches the other's file."""
    files, folder = open_folder(uri)
    files.create_dir(folder, recursive=True)
    own, size = f"{name}-{uuid.uuid4().hex}", 0
    with files.open_output_stream(f"{folder}/{own}") as out:
        for block in blocks:
            out.write(block)
            size += len(block)
    return own, size


# ------------------------------------------------------------------------------------------------ vectors
def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """``id, v`` (float64 bytes, 8 a component) of the vectors that can be compared, and ``id`` of the other rows.

    Not comparable: null ids, and vectors that are null, empty, zero or hold null or non-finite components.  Lengths may differ.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("id").isNotNull() & F.col("x").isNotNull() & ~bad & F.exists("x", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    return rows.where("good").select("id", "x").mapInArrow(_packed, "id long, v binary"), rows.where("not good").select("id")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False) + 0.0  # -0.0 and 0.0 are the same component
        ends = np.cumsum([len(x) for x in batch.column(1)], dtype=np.int64)[:-1]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in np.split(flat, ends)][: batch.num_rows], pa.binary())], ["id", "v"])


def unpacked(values) -> np.ndarray:
    """Rows of packed vectors as a matrix of doubles."""
    values = list(values)
    return np.frombuffer(b"".join(values), dtype="<f8").reshape(len(values), -1) if values else np.zeros((0, 0))
