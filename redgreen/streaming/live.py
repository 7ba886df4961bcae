"""Live detection: micro-batches of jobs land, and the occurrences they touch are found anew.

The landed table is the state. It holds every attempt once, so a signature's
attempts may be any time apart, no watermark cuts them, and a batch that is
replayed after a failure changes nothing. What a batch costs follows the
signatures it brings, whose attempts alone are looked at again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from redgreen.functions.text import short_hash, text_or_empty
from redgreen.operators import detect as d
from redgreen.sources.landing import CODEC, land, tidy_shuffles

PART = "part"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _aside(table: DataFrame, path: str) -> DataFrame:
    table.write.option("compression", CODEC).parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def update(batch: DataFrame, jobs_path: str, out_path: str, min_attempts: int = d.MIN_ATTEMPTS, parts: int = 16, period: str = "day") -> None:
    """Land a batch, then replace the occurrences of its signatures.

    Occurrences lie in ``parts`` partitions by a hash of their id, of which
    only those with a touched signature are written. A signature that is no
    longer flaky, because an execution came again with another conclusion, is
    marked so.
    """
    land(batch, jobs_path, period=period)
    with tidy_shuffles(batch.sparkSession):
        _replace(batch, jobs_path, out_path, min_attempts, parts)


def _replace(batch: DataFrame, jobs_path: str, out_path: str, min_attempts: int, parts: int) -> None:
    spark = batch.sparkSession
    aside = f"{out_path}/_update-{uuid.uuid4().hex}"
    jobs = spark.read.parquet(jobs_path)
    # Also of rows that no longer count, which may have done so before.
    named = batch.withColumn("workflow_file", text_or_empty("workflow_file")).where((F.col("head_sha") != "") & (F.col("job_name") != ""))
    part = F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(parts)).cast("int")
    exists = _exists(spark, out_path)
    # Attempts of the signatures meet once: they are counted where their details are found.
    touched = named.select(*d.SIGNATURE).distinct()
    found = d.flaky_signatures(d.occurrences_of(d.attempts_of(jobs, touched)), min_attempts).withColumns({"flaky": F.lit(True), PART: part})
    if exists:
        # What is used more than once is written aside, and neither found nor moved again.
        found, schema = _aside(found, f"{aside}/found"), found.schema
        ids = _aside(named.select(short_hash(*d.SIGNATURE).alias("id")).distinct().withColumn(PART, part), f"{aside}/ids")
        wanted = [r[PART] for r in ids.select(PART).distinct().collect()]  # ``parts`` values at the most
        old = spark.read.schema(schema).parquet(out_path).where(F.col(PART).isin(wanted))
        # Of the touched ones, those found anew give way, the others are no longer flaky; old rows meet both once.
        both = ids.withColumn("_found", F.lit(False)).unionByName(found.select("id", PART, F.lit(True).alias("_found")))
        met = old.join(both.groupBy("id", PART).agg(F.bool_or("_found").alias("_found")), ["id", PART], "left")
        left = met.where("_found is null or not _found").withColumn("flaky", F.col("flaky") & F.col("_found").isNull())
        found = found.unionByName(left.select(*found.columns))
    writer = found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", CODEC)
    writer.partitionBy(PART).parquet(out_path)
    if exists:
        at = spark._jvm.org.apache.hadoop.fs.Path(aside)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def follow(
    stream: DataFrame, jobs_path: str, out_path: str, checkpoint: str, min_attempts: int = d.MIN_ATTEMPTS, parts: int = 16, period: str = "day", **trigger: object
) -> StreamingQuery:
    """``update`` for every micro-batch of a stream of job rows; ``availableNow=True`` takes what is there and ends."""

    def each(batch: DataFrame, number: int) -> None:
        update(batch, jobs_path, out_path, min_attempts, parts, period)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def occurrences(spark: SparkSession, out_path: str) -> DataFrame:
    """The occurrences as of the last batch, as ``detect`` gives them."""
    return spark.read.parquet(out_path).where("flaky").drop("flaky", PART)
