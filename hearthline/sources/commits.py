"""A log of commits: numbered entries, made only if absent, each naming every folder that is live.

Writers put their data into folders of names never used before, then make the next entry.  An entry is written aside and
renamed into its number, which fails where another writer has taken that number; the change is then worked out again on the
newer entry.  So a reader sees all of a run or nothing of it, and of two writers neither is lost.  The rename must not replace
files: HDFS keeps that between processes, a local disk only within one.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_LOCK = threading.Lock()


class Conflict(RuntimeError):
    """Another writer has changed what this commit builds on."""


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = hadoop_path(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file that others see whole or not at all; False where it is there already."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, fs = hadoop_path(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), conf)
    never_replace = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    with _LOCK:
        try:
            files.rename(fs.makeQualified(aside), fs.makeQualified(target), never_replace)
            return True
        except Py4JJavaError as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or fs.exists(target):
                return False
            raise


class CommitLog:
    """The entries of one root; entry 0 is empty and not written."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, f"{root}/_log"

    def numbers(self) -> list[int]:
        where, fs = hadoop_path(self.spark, self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n) for n in names if n.isdigit())

    def at(self, number: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.folder}/{number:012d}"))

    def last(self) -> tuple[int, dict]:
        found = self.numbers()
        return (found[-1], self.at(found[-1])) if found else (0, {})

    def commit(self, change: Callable[[dict], dict]) -> dict:
        """Make the next entry from the newest one; ``change`` may raise ``Conflict`` and is called again on a lost race."""
        while True:
            number, now = self.last()
            new = change(json.loads(json.dumps(now)))
            if put_if_absent(self.spark, f"{self.folder}/{number + 1:012d}", json.dumps(new, sort_keys=True)):
                return new

    def forget(self, keep: int, named: Callable[[dict], set[str]]) -> set[str]:
        """Remove all but the newest ``keep`` entries; gives the folders that only those named."""
        numbers = self.numbers()
        old, kept = numbers[:-keep], numbers[-keep:]
        gone: set[str] = set().union(*(named(self.at(n)) for n in old)) - set().union(*(named(self.at(n)) for n in kept))
        for n in old:
            where, fs = hadoop_path(self.spark, f"{self.folder}/{n:012d}")
            fs.delete(where, False)
        return gone


def folders(value: object) -> Iterator[str]:
    """Every folder that an entry names, however deep: strings under ``data/``."""
    if isinstance(value, str):
        if value.startswith("data/"):
            yield value
    elif isinstance(value, (dict, list)):
        for x in value.values() if isinstance(value, dict) else value:
            yield from folders(x)
