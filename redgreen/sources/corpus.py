"""Labelled corpora: cases with a checked label, joined to their log texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redgreen.operators.taxonomy import is_category
from redgreen.schemas import CORPUS_DOCUMENT


def _decoded(path: Column) -> Column:
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def check_labels(cases: DataFrame) -> DataFrame:
    """Fail on the first label outside the closed set."""
    message = F.format_string("case %s has an invalid label: unknown category %s", "id", "expected_category")
    label = F.when(is_category("expected_category"), F.col("expected_category")).otherwise(
        F.raise_error(message).cast("string")
    )
    return cases.withColumn("expected_category", label)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Case rows ``(id, log, expected_category, note, log_path)``; empty corpus or bad label fails."""
    docs = spark.read.schema(CORPUS_DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return _cases(docs.withColumn("file", _decoded(F.col("_metadata.file_path"))))


def corpus_rows(documents: DataFrame) -> DataFrame:
    """Case rows of corpora held as text, ``(file, document)``; logs are named relative to the file."""
    parsed = F.from_json("document", CORPUS_DOCUMENT, {"mode": "FAILFAST"}).alias("d")
    return _cases(documents.select("file", parsed).select("file", "d.*"))


def _cases(docs: DataFrame) -> DataFrame:
    empty = F.raise_error(F.concat(F.lit("corpus "), F.col("file"), F.lit(" contains no cases")))
    cases = F.when(F.size("cases") > 0, F.col("cases")).otherwise(empty.cast(docs.schema["cases"].dataType))
    rows = docs.select("file", F.inline(cases))
    folder = F.regexp_replace("file", "/[^/]*$", "/")
    rows = rows.withColumn("log_path", F.concat(folder, F.regexp_replace("log", r"^(\./)+", "")))
    return check_labels(rows).drop("file")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """``(log_path, excerpt)``: every file below a directory as one whole text."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(_decoded(F.col("_metadata.file_path")).alias("log_path"), F.col("value").alias("excerpt"))


def with_log_text(cases: DataFrame, logs: DataFrame) -> DataFrame:
    """Equi-join on path; a case whose log is missing fails the run."""
    joined = cases.join(logs.withColumn("found", F.lit(True)), "log_path", "left")
    missing = F.raise_error(F.format_string("reading log for case %s: no such file", "id")).cast("string")
    return joined.withColumn("excerpt", F.when(F.col("found"), F.col("excerpt")).otherwise(missing)).drop("found")
