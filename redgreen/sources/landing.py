"""Landing batches of job rows: a table in day partitions that repeats nothing."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from redgreen.functions.text import text_or_empty
from redgreen.operators.detect import SIGNATURE

# What tells one execution of a job from another.
JOB_KEY = ["run_id", "run_attempt", "job_id"]
DAY = "day"
# Of landed files, which are written once and read often.
CODEC = "zstd"
# Rows of a bucket over all days, from which a table gets more buckets.
BUCKET_ROWS = 2_000_000
# Rows of a landed file, about.
FILE_ROWS = 500_000


def day_of(column: str = "started_at", period: str = "day") -> Column:
    """The UTC day of a time, or the first one of its ``week``, ``month``, ``quarter`` or ``year``; null for a null time."""
    day = F.to_date(F.to_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone()))
    return day if period == "day" else F.trunc(day, period)


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, the files of a step's shuffles go when the step ends, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def latest(batch: DataFrame, key: Sequence[str] = JOB_KEY) -> DataFrame:
    """One row per key: equal rows once, and of different ones the greatest, column by column.

    Each task passes on one row per key, and rows are moved once.
    """
    return batch.withColumn("_place", F.row_number().over(_greatest(batch, key))).where("_place = 1").drop("_place")


def _greatest(batch: DataFrame, key: Sequence[str], *more: str) -> WindowSpec:
    return Window.partitionBy(*key, *more).orderBy(*[F.desc(c) for c in batch.columns if c not in key])


def news_of(batch: DataFrame, known: DataFrame, key: Sequence[str] = JOB_KEY) -> DataFrame:
    """The rows of ``latest(batch)`` that ``known``, of the same columns, does not hold.

    Both sides move once, by the key. Of what is known only the key and a
    128-bit digest of the row move, which rows of one key are compared by.
    """
    others = [c for c in batch.columns if c not in key]
    digest = [F.xxhash64(F.lit(seed), *[x for c in others for x in (F.col(c).isNull(), F.col(c))]) for seed in (1, 2)]
    names, none = ["_digest", "_digest2"], F.lit(None).cast("bigint")
    side = known.select(*key, *[F.lit(None).cast(batch.schema[c].dataType).alias(c) for c in others], *[x.alias(n) for x, n in zip(digest, names)], F.lit(True).alias("_known"))
    sent = batch.select(*key, *others, *[none.alias(n) for n in names], F.lit(False).alias("_known"))
    both = side.unionByName(sent).repartition(*key)
    both = both.withColumns({n: F.coalesce(n, x) for x, n in zip(digest, names)})
    greatest = both.withColumn("_place", F.row_number().over(_greatest(batch, key, "_known"))).where("_known or _place = 1")
    held = F.bool_or("_known").over(Window.partitionBy(*key, *names))
    return greatest.withColumn("_held", held).where("not _known and not _held").select(*batch.columns)


def _hash(columns: Sequence[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def changes_of(batch: DataFrame, known: DataFrame | None, key: Sequence[str] = JOB_KEY) -> DataFrame:
    """``(day, _several, n)``: how many keys of a batch bring something new on a day.

    Of every row only 128 bits move, a hash of its key and one of all of it,
    and its day. Keys that the batch holds different rows of are listed by
    their hash under ``_several``, without a day: which of them counts, only
    the rows tell.
    """

    def marks(rows: DataFrame, sent: bool) -> DataFrame:
        return rows.select(_hash(key, 1).alias("_key"), _hash(batch.columns, 2).alias("_row"), DAY, F.lit(sent).alias("_sent"))

    both = marks(batch, True) if known is None else marks(batch, True).unionByName(marks(known, False))
    rows = both.repartition("_key").groupBy("_key", "_row").agg(F.bool_or("_sent").alias("_sent"), F.bool_or(~F.col("_sent")).alias("_known"), F.max(DAY).alias(DAY))
    keys = rows.where("_sent").groupBy("_key").agg(F.count(F.lit(1)).alias("_rows"), F.bool_and("_known").alias("_known"), F.max(DAY).alias(DAY))
    several = F.col("_rows") > 1
    new = keys.where(several | ~F.col("_known")).select(F.when(~several, F.col(DAY)).alias(DAY), F.when(several, F.col("_key")).alias("_several"))
    return new.groupBy(DAY, "_several").agg(F.count(F.lit(1)).alias("n"))


def land(
    batch: DataFrame, path: str, key: Sequence[str] = JOB_KEY, time: str = "started_at", period: str = "day"
) -> list[date | None]:
    """Merge a batch into the table at ``path``; the days whose files changed.

    The table is partitioned by the UTC day of ``time`` (or by the first day of
    a longer ``period``, for histories with few rows a day), so windows over
    days prune files. A row replaces the one of its key and day. Only days on which
    the batch brings something new are written anew; landing the same batch
    twice changes no file. A key belongs to its day: an execution starts once.

    Hashes of rows tell the days with changes, so a batch that brings nothing
    moves no row. Rows of these days, landed ones and those of the batch, then
    move once, to the file they are written to, where they meet and are
    replaced in one job. Only keys with different rows in one batch move apart
    before, for the greatest of them.
    """
    with tidy_shuffles(batch.sparkSession):
        return _merge(batch, path, key, time, period)


def _merge(batch: DataFrame, path: str, key: Sequence[str], time: str, period: str) -> list[date | None]:
    spark = batch.sparkSession
    files, at = _path(spark, path)
    dated = batch.withColumn(DAY, day_of(time, period))
    exists = files.exists(at) and any(s.getPath().getName().startswith(f"{DAY}=") for s in files.listStatus(at))
    known = None
    if exists:
        days = [r[DAY] for r in dated.select(DAY).distinct().collect()]  # one value per day of the batch
        known = spark.read.schema(dated.schema).parquet(path).where(_on_days(days))
    aside = f"{path}/_landing-{uuid.uuid4().hex}"
    changes = _aside(changes_of(dated, known, key), f"{aside}/changes")
    counts = Counter({r[DAY]: r["n"] for r in changes.where("_several is null").collect()})  # one row per day
    parts = [dated.withColumn("_key", _hash(key, 1))]
    several = changes.where("_several is not null").select(F.col("_several").alias("_key"))
    if not several.isEmpty():
        sent = parts[0].join(several, "_key", "left_semi").drop("_key")
        held = known.withColumn("_key", _hash(key, 1)).join(several, "_key", "left_semi").drop("_key") if exists else None
        news = _aside(news_of(sent, held, key) if exists else latest(sent, key), f"{aside}/news")
        counts.update({r[DAY]: r["count"] for r in news.groupBy(DAY).count().collect()})
        parts = [parts[0].join(several, "_key", "left_anti"), news.withColumn("_key", _hash(key, 1))]
    parts = [x.withColumn("_sent", F.lit(True)) for x in parts]
    changed = _sorted(counts)
    if exists and changed:
        other = known.where(_on_days(changed))
        counts.update({r[DAY]: r["count"] for r in other.groupBy(DAY).count().collect()})
        parts.append(other.withColumns({"_key": _hash(key, 1), "_sent": F.lit(False)}))
    if changed or not exists:
        _write_days(reduce(DataFrame.unionByName, parts), counts, path, key)
    files.delete(_path(spark, aside)[1], True)
    return changed


def _aside(rows: DataFrame, path: str) -> DataFrame:
    rows.write.option("compression", CODEC).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _write_days(rows: DataFrame, counts: dict[date | None, int], path: str, key: Sequence[str]) -> None:
    """Replace the counted days by their rows, one a key of those ``_sent``, and others of which no key is sent.

    Rows move once, to their day and, on days of many rows, to a part of it by
    their key; each part becomes a file, or small ones together.
    """
    spark, columns = rows.sparkSession, [c for c in rows.columns if c not in ("_key", "_sent")]
    parts = spark.createDataFrame([(day, -(-n // FILE_ROWS)) for day, n in counts.items()], "_of date, _parts int")
    placed = rows.join(F.broadcast(parts), F.col(DAY).eqNullSafe(F.col("_of"))).select(*columns, "_sent", F.pmod("_key", "_parts").cast("int").alias("_part"))
    met = Window.partitionBy(DAY, "_part", *key).orderBy(F.desc("_sent"))
    placed = placed.repartition(DAY, "_part").withColumns({"_place": F.row_number().over(met), "_new": F.first("_sent").over(met)})
    kept = placed.where("_place = 1 or not _new").select(*columns)
    writer = kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("compression", CODEC).partitionBy(DAY).parquet(path)


def _sorted(days: Iterable[date | None]) -> list[date | None]:
    return sorted(days, key=lambda d: (d is not None, d))


def land_table(jobs: DataFrame, name: str, path: str | None = None, buckets: int = 64, time: str = "started_at", period: str = "day") -> DataFrame:
    """Job rows as a table of the catalog, partitioned by day and bucketed by signature.

    Detection over such a table (``detect(..., clean=True)``) moves no job row:
    attempts of a signature are in one bucket of every day already. A hot
    commit spreads over buckets by its jobs. Choose as many buckets as tasks
    should read the table; each writes one file a day. A table of more than
    ``BUCKET_ROWS`` rows a bucket gets more of them, so that what one task
    writes and reads stays the same however many rows there are.
    """
    buckets = max(buckets, -(-jobs.count() // BUCKET_ROWS))
    keys = {k: text_or_empty(k) for k in (*SIGNATURE, "conclusion")}
    rows = jobs.withColumns({**keys, DAY: day_of(time, period)}).repartition(buckets, *SIGNATURE)
    writer = rows.write.mode("errorifexists").format("parquet").partitionBy(DAY).bucketBy(buckets, *SIGNATURE).sortBy(*SIGNATURE)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return jobs.sparkSession.table(name)


def on_days(jobs: DataFrame, days: DataFrame) -> DataFrame:
    """Rows of the listed days, say those that a batch has changed; files of other days are not opened.

    Days are one value per partition of the table at the most, so they are
    broadcast, and the engine prunes partitions by them before it reads.
    """
    return jobs.join(F.broadcast(days.select(DAY).distinct()), DAY, "left_semi")


def _on_days(days: Sequence[date | None]) -> Column:
    listed = F.col(DAY).isin([d for d in days if d is not None])
    return listed | F.col(DAY).isNull() if None in days else listed
