"""JSON sinks and sources for scans, classified items and scores.

Results are directories of JSON lines, one per table, so each is written and
read by as many tasks as it has files. The single-document forms, with runs and
items nested in one JSON value, can be read too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from redgreen.operators import detect as d
from redgreen.operators.detect import SIGNATURE
from redgreen.sources.jobs import for_workflow
from redgreen.sources.landing import CODEC
from redgreen.schemas import CLASSIFIED_DOCUMENT, SCAN_DOCUMENT


def write_json(df: DataFrame, path: str) -> None:
    """Compressed lines: the keys that each repeats are most of them. Any reader of JSON lines takes them as they are.

    Documents with maps, as scores are, stay plain: their keys differ, and people open them.
    """
    codec = "none" if any(isinstance(f.dataType, MapType) for f in df.schema) else "gzip"
    df.write.mode("errorifexists").option("compression", codec).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_scan(header: dict[str, str], summary: DataFrame, occurrences: DataFrame, runs: DataFrame, path: str) -> None:
    """One scan under one directory: ``summary`` (with the header), ``occurrences``, ``runs``."""
    write_json(summary.withColumns({k: F.lit(v) for k, v in header.items()}), f"{path}/summary")
    write_json(occurrences, f"{path}/occurrences")
    write_json(runs, f"{path}/runs")


def scan_counts(signatures: DataFrame, min_attempts: int = d.MIN_ATTEMPTS, by: Sequence[str] = ()) -> DataFrame:
    """Rows of ``kind`` flaky, one for each flaky signature, and of ``kind`` total, one for each value of ``by``.

    Both use every count, so that the engine sees one shuffle and makes it once.
    """
    flaky = d.flaky_signatures(signatures, min_attempts).withColumn("kind", F.lit("flaky"))
    total = d.scanned(signatures, by).withColumn("kind", F.lit("total"))
    return flaky.unionByName(total, allowMissingColumns=True)


def land_scan(
    jobs: DataFrame, path: str, workflow_file: str = "", min_attempts: int = d.MIN_ATTEMPTS, by: Sequence[str] = (), header: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One scan, written once: ``(summary, occurrences, runs)``, read back from one directory.

    Jobs are read twice and not once for each output: a first pass counts them
    by signature, which gives the totals and the flaky signatures in one job
    over one shuffle; a second one fetches the flaky attempts. Occurrences and
    runs come from those attempts, the summary from what is written by then.
    The two tables in between stay under names that readers of a directory skip.
    """
    spark = jobs.sparkSession
    kept = for_workflow(jobs, workflow_file)
    counted = d.signatures(kept, by)
    both = scan_counts(counted, min_attempts, by)
    both.write.mode("errorifexists").option("compression", CODEC).parquet(f"{path}/_counts")
    counts = spark.read.schema(both.schema).parquet(f"{path}/_counts")
    attempts = d.attempts_of(kept, counts.where("kind = 'flaky'"), by)
    attempts.write.mode("errorifexists").option("compression", CODEC).parquet(f"{path}/_attempts")
    attempts = spark.read.schema(attempts.schema).parquet(f"{path}/_attempts")
    occurrences, runs = d.occurrences_of(attempts, by), d.runs_of(attempts, by)
    out = []
    for name, table in (("occurrences", occurrences), ("runs", runs)):
        write_json(table, f"{path}/{name}")
        out.append(spark.read.schema(table.schema).option("mode", "FAILFAST").json(f"{path}/{name}"))
    totals = counts.where("kind = 'total'").select(*by, "total_jobs", "distinct_commits")
    summary = d.with_flaky(totals, out[0], by).withColumns({k: F.lit(v) for k, v in (header or {}).items()})
    write_json(summary, f"{path}/summary")
    return spark.read.schema(summary.schema).option("mode", "FAILFAST").json(f"{path}/summary"), *out


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _flat_occurrence(o: Column) -> list[Column]:
    last_fail, last_pass = F.try_element_at(o["failed_runs"], F.lit(-1)), F.try_element_at(o["passed_runs"], F.lit(-1))
    fields = ["id", "head_sha", "branch", "workflow_name", "workflow_file", "job_name", "total_attempts", "failure_rate"]
    failure = F.struct(
        *[last_fail[f].alias(f) for f in ("run_id", "run_attempt", "job_id", "started_at", "conclusion", "url")]
    )
    return [
        *[o[f].alias(f) for f in fields],
        F.greatest(F.size(o["failed_runs"]), F.lit(0)).alias("failed_runs"),
        F.greatest(F.size(o["passed_runs"]), F.lit(0)).alias("passed_runs"),
        F.when(last_fail.isNotNull(), failure).alias("primary_failure"),
        last_pass["url"].alias("last_pass_url"),
    ]


def read_scan_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(summary, occurrences, runs)`` of a scan stored as one nested document."""
    docs = _documents(spark, path, SCAN_DOCUMENT)
    summary = docs.select("repo", "source", "generated_at", "window_days", "summary.*")
    each = docs.select(F.explode("occurrences").alias("o"))
    occurrences = each.select(*_flat_occurrence(F.col("o")))
    sides = [
        each.select(F.col("o.id").alias("id"), F.lit(outcome).alias("outcome"), F.inline(f"o.{outcome}_runs"))
        for outcome in ("failed", "passed")
    ]
    runs = sides[0].unionByName(sides[1]).drop("job_name", "workflow_name", "branch", *SIGNATURE)
    return summary, occurrences, runs


def read_classified_document(spark: SparkSession, path: str) -> DataFrame:
    """Item rows, as the report operators take them, of one nested document."""
    items = _documents(spark, path, CLASSIFIED_DOCUMENT).select(
        "repo", "source", "generated_at", "provider", "model", "baseline", F.explode("items").alias("i")
    )
    flat = items.select("*", *_flat_occurrence(F.col("i.occurrence")), "i.verdict", "i.step_name", "i.excerpt_len", "i.error")
    return flat.withColumns({"failing_url": F.col("primary_failure.url"), "passing_url": F.col("last_pass_url")}).drop("i")
