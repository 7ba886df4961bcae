"""What the operators share: picking columns, tables in the shared folder, shipping the package."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Columns by exact name, under new names; the first of several equal ones.

    Other columns are left out, so none of their names can clash with a derived
    one, and names that differ in case only are told apart.
    """
    places = [df.columns.index(source) for source in columns.values()]
    numbered = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"_{i}").alias(name) for name, i in zip(columns, places)])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that no column of ``df`` has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and Spark runs on one machine alone, as
    in tests, a temporary folder of this process takes its place; a cluster's
    executors would each write to their own, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="redgreen-"))
    return _LOCAL[0]


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage: a lost executor costs neither these rows nor what made
    them. The path is kept in ``durable_path`` for ``discard``.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.durable_path = path
    return table


def reread(table: DataFrame) -> DataFrame:
    """A table of ``durable`` once more, with columns of its own, to meet itself in a join."""
    again = table.sparkSession.read.schema(table.schema).parquet(table.durable_path)
    again.durable_path = table.durable_path
    return again


def discard(tables: Iterable[DataFrame]) -> None:
    """Delete tables of ``durable`` that no later result reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.durable_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed for them."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    context = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_redgreen_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="redgreen-"), "redgreen.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "redgreen")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, root))
    context.addPyFile(archive)
    context._redgreen_shipped = True


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives its memory back when its task ends.

    Workers stay for later tasks, and what a task has freed would stay with
    them, beside an engine that wants the memory for a stage without Python.
    """

    @functools.wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def release() -> None:
    """Return freed memory to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def remainder(id_column: str, divisor: int) -> Column:
    """``crc32`` of the id's decimal text modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % divisor
