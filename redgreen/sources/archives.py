"""Log archives: zip files of step logs to step rows, and the job to log lookup."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redgreen.functions.logs import step_file, strip_stamps
from redgreen.functions.text import text_or_empty
from redgreen.schemas import ARCHIVE_ENTRIES, STEP_LOG

# Characters and rows of opened archives that a task passes on at once; an archive of more goes by itself.
HELD_BYTES = 4 << 20
HELD_ROWS = 10_000


def _zip_files(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, path, length, content)`` of every zip below a directory, archive = its path below it."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    )
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    # The root is cut off at the front only: its name may come again further down, and archives of different folders may share one.
    below = F.when(F.startswith("path", F.lit(root)), F.substring("path", F.lit(len(root) + 1), F.length("path")))
    return files.select(F.coalesce(below, "path").alias("archive"), "path", "length", "content")


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, path, length)``: names only, no archive is opened.

    Join with the names that are wanted, then read those with ``read_listed``.
    """
    return _zip_files(spark, path).drop("content")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, content)`` of every zip below a directory."""
    return _zip_files(spark, path).select("archive", "content")


def open_path(path: str) -> BinaryIO:
    """A file for reading at any place: of this machine or a mounted one, else through the file systems that Arrow knows."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return open("/" + rest.lstrip("/") if colon else path, "rb")
    from pyarrow import fs

    authority, _, key = rest.lstrip("/").partition("/")
    files, base = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{authority}/")
    return files.open_input_file(f"{base.rstrip('/')}/{key}")


def _unzipper(nested: bool, max_bytes: int | None, opener: Callable[[str], BinaryIO]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function over ``(archive, content)`` or ``(archive, path)``: a row for each entry, or one with all entries."""
    held_bytes, held_rows = HELD_BYTES, HELD_ROWS
    step = ["job_dir", "entry_no", "entry_name", "raw_body"]
    columns = ["archive", *(["steps"] if nested else step), "error"]

    # Nested, so that workers get the functions themselves and need no installed package.
    def entries(file: BinaryIO) -> list[tuple]:
        left, found = max_bytes, []
        with zipfile.ZipFile(file) as zipped:
            for info in zipped.infolist():
                if info.is_dir() or not info.filename.lower().endswith(".txt"):
                    continue
                with zipped.open(info) as entry:
                    body = entry.read(left)
                if left is not None:
                    left -= len(body)
                    if left <= 0:
                        raise ValueError(f"log archive exceeds {max_bytes} bytes; refusing to expand further")
                folder, _, base = info.filename.rpartition("/")
                found.append((folder or ".", len(found), base, body.decode("utf-8", "replace")))
        if not found:
            raise ValueError("log archive contained no .txt step files")
        return found

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Spark bounds a batch by bytes, and archives expand one at a time up to the cap. What they expand to is passed on
        # many archives at once, as a batch of its own for each costs more than opening it.
        rows, held = [], 0

        def table() -> pd.DataFrame:
            return pd.DataFrame(rows, columns=columns, dtype=object)

        for batch in batches:
            source = "content" if "content" in batch.columns else "path"
            for archive, given in zip(batch["archive"], batch[source]):
                found, error = [], None
                try:
                    with io.BytesIO(given) if source == "content" else opener(given) as file:
                        found = entries(file)
                except ValueError as problem:  # the archive's content
                    error = f"reading archive: {problem}"
                except Exception as problem:  # the container, or a corrupt stream in it
                    error = f"reading archive: opening log archive: {problem}"
                size = sum(len(entry[3]) for entry in found)
                if rows and held + size > held_bytes:  # a large one does not wait beside others
                    yield table()
                    rows, held = [], 0
                if nested:
                    rows.append((archive, [dict(zip(step, entry)) for entry in found], error))
                else:
                    rows += [(archive, *entry, None) for entry in found] or [(archive, None, None, None, None, error)]
                held += size
                if held >= held_bytes or len(rows) >= held_rows:
                    yield table()
                    rows, held = [], 0
        if rows:
            yield table()

    return unzip


def _spread(archives: DataFrame) -> DataFrame:
    """What the unzippers read; listed names are small, so sizes say nothing about the work and they are dealt by number."""
    if "content" in archives.columns:
        return archives.select("archive", "content")
    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive", "path").repartition(tasks, "path")


def unzip_steps(archives: DataFrame, max_bytes: int | None = None, opener: Callable[[str], BinaryIO] = open_path) -> DataFrame:
    """One row per step file, or one row with ``error`` for an unusable archive.

    ``archives`` holds contents, or the paths of ``list_archives``, each opened
    by ``opener`` in the task that reads it. With ``max_bytes`` an archive that
    expands to as many bytes or more counts as unusable; without it any size is
    read, entry by entry.

    Filter archives first: a predicate cannot be pushed through the Python
    worker. Land the result as a table when more than one query reads it, so
    nothing is expanded twice.
    """
    raw = _spread(archives).mapInPandas(_unzipper(False, max_bytes, opener), STEP_LOG)
    parsed = step_file("entry_name")
    return raw.select(
        "archive",
        "job_dir",
        parsed["step_order"].alias("step_order"),
        parsed["step_name"].alias("step_name"),
        "entry_no",
        strip_stamps("raw_body").alias("body"),
        "error",
    )


def archives_with_steps(archives: DataFrame, max_bytes: int | None = None, opener: Callable[[str], BinaryIO] = open_path) -> DataFrame:
    """``(archive, steps, error)``: one row per archive that holds its steps, as ``unzip_steps`` has them.

    An archive is one file, read by one task; its steps stay together, so what
    is asked of an archive as a whole needs no shuffle.
    """
    raw = _spread(archives).mapInPandas(_unzipper(True, max_bytes, opener), ARCHIVE_ENTRIES)

    def step(entry: Column) -> Column:
        parsed = step_file(entry["entry_name"])
        return F.struct(
            entry["job_dir"].alias("job_dir"),
            parsed["step_order"].alias("step_order"),
            parsed["step_name"].alias("step_name"),
            entry["entry_no"].alias("entry_no"),
            strip_stamps(entry["raw_body"]).alias("body"),
        )

    return raw.select("archive", F.transform("steps", step).alias("steps"), "error")


def step_position() -> Column:
    """Order of steps in an archive: folder, number, then place in the archive."""
    return F.struct("job_dir", "step_order", "entry_no")


def locate_logs(failures: DataFrame, index: DataFrame) -> DataFrame:
    """Add ``log_archive`` and, where there is none, ``log_error``, by ``job_id``.

    ``index`` is ``(job_id, log_archive)``, the archive's path below the log
    folder as ``read_archives`` gives it; a job listed twice keeps its
    smallest archive name, found by a map-side combined minimum.
    """
    listed = index.groupBy("job_id").agg(F.min(text_or_empty("log_archive")).alias("log_archive"), F.lit(True).alias("listed"))
    found = failures.join(listed, "job_id", "left")
    error = F.when(
        F.col("listed").isNull(), F.concat(F.lit("no job with id "), F.col("job_id").cast("string"))
    ).when(
        F.col("log_archive") == "",
        F.concat(F.lit("job "), F.col("job_id").cast("string"), F.lit(" has no log archive")),
    )
    return found.withColumn("log_error", error).drop("listed")
