"""Job-execution sources and the filters a scan applies to them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redgreen.functions.text import col, text_or_empty
from redgreen.schemas import INDEX_DOCUMENT, INDEX_JOB, JOB_COLUMNS

# Scan defaults.
DEFAULT_DAYS = 7
DEFAULT_MAX_RUNS = 200

# RFC 3339, and the two layouts without a zone, which mean UTC.
_CLOCK = r"\d{1,2}:\d{2}:\d{2}([.,]\d+)?"
TIMESTAMP_LAYOUTS = rf"^\d{{4}}-\d{{2}}-\d{{2}}(T{_CLOCK}(Z|[+-]\d{{2}}:\d{{2}})?| {_CLOCK})$"

_KEYS = ["job_name", "workflow_name", "workflow_file", "head_sha", "branch", "conclusion", "url"]


def parse_time(c: Column | str) -> Column:
    """Timestamp of an accepted layout; null for '' and for anything else.

    A text without a zone is UTC whatever the session's zone.
    """
    c = col(c)
    zoned = F.when(F.rlike(c, F.lit(r"(Z|[+-]\d{2}:\d{2})$")), c).otherwise(F.concat(c, F.lit("Z")))
    return F.when(F.rlike(c, F.lit(TIMESTAMP_LAYOUTS)), F.try_to_timestamp(F.replace(zoned, F.lit(","), F.lit("."))))


def bad_time(c: Column | str) -> Column:
    """True for a non-empty text that no layout reads."""
    return (text_or_empty(c) != "") & parse_time(c).isNull()


def normalise_jobs(jobs: DataFrame, strict: bool = True) -> DataFrame:
    """Typed job rows: text keys never null, ``started_at`` a UTC timestamp.

    An unreadable time fails the read when strict; otherwise such rows are
    left out here and available from ``rejected_jobs``.
    """
    time = parse_time("started_at")
    if strict:
        message = F.format_string("job %s has an unparseable started_at: %s", F.col("job_id"), F.col("started_at"))
        time = F.when(bad_time("started_at"), F.raise_error(message).cast("timestamp")).otherwise(time)
    else:
        jobs = jobs.where(~bad_time("started_at"))
    return jobs.withColumns({**{k: text_or_empty(k) for k in _KEYS}, "started_at": time})


def rejected_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(bad_time("started_at"))


def _listed_jobs(docs: DataFrame) -> DataFrame:
    """Jobs of decoded documents ``(file, repo, jobs)``; one without jobs is an error."""
    empty = F.raise_error(F.concat(F.col("file"), F.lit(" contains no jobs"))).cast(docs.schema["jobs"].dataType)
    jobs = F.when(F.size("jobs") > 0, F.col("jobs")).otherwise(empty)
    return docs.select("repo", F.inline(jobs))


def index_rows(documents: DataFrame) -> DataFrame:
    """Raw job rows of index documents held as text, ``(file, document)``; malformed JSON is an error."""
    parsed = F.from_json("document", INDEX_DOCUMENT, {"mode": "FAILFAST"}).alias("d")
    return _listed_jobs(documents.select("file", parsed).select("file", "d.*"))


def line_rows(lines: DataFrame) -> DataFrame:
    """Raw job rows of JSON lines held as text, ``(line)``; a malformed line is an error."""
    return lines.select(F.from_json("line", INDEX_JOB, {"mode": "FAILFAST"}).alias("j")).select("j.*")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Raw job rows of index documents: ``{"repo": ..., "jobs": [...]}``.

    A document without jobs is an error, as is malformed JSON.
    """
    docs = spark.read.schema(INDEX_DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return _listed_jobs(docs.withColumn("file", F.col("_metadata.file_path")))


def read_jobs(spark: SparkSession, path: str, fmt: str = "index", strict: bool = True) -> DataFrame:
    """Job rows from an index document, JSON lines or Parquet.

    Large histories belong in Parquet, partitioned by day: the workflow and
    time filters below then prune files. An index document is one task.
    """
    if fmt == "index":
        raw = read_index(spark, path)
    elif fmt == "json":
        raw = spark.read.schema(INDEX_JOB).option("mode", "FAILFAST").json(path)
    elif fmt == "parquet":
        raw = spark.read.parquet(path)
        if dict(raw.dtypes)["started_at"] != "string":
            return raw.withColumns({k: text_or_empty(k) for k in _KEYS})
    else:
        raise ValueError(f"unknown job format {fmt!r} (want index, json or parquet)")
    return normalise_jobs(raw, strict)


def job_results(jobs: DataFrame) -> DataFrame:
    return jobs.select(*JOB_COLUMNS)


def for_workflow(jobs: DataFrame, workflow_file: str = "") -> DataFrame:
    """Rows of one workflow file; all rows when the name is empty."""
    return jobs.where(F.col("workflow_file") == workflow_file) if workflow_file else jobs


def within_days(runs: DataFrame, as_of: date, days: int = DEFAULT_DAYS, column: str = "created_at") -> DataFrame:
    """Rows created on or after the day ``days`` before ``as_of``.

    Days are UTC whatever the session's zone. The bound is a literal compared
    with the bare column, so it reaches the Parquet reader.
    """
    if days < 1:
        raise ValueError(f"days must be at least 1, got {days}")
    since = date.fromordinal(as_of.toordinal() - days)
    kind = dict(runs.dtypes)[column]
    bound = F.lit(f"{since.isoformat()}T00:00:00Z" if kind == "timestamp" else since.isoformat()).cast(kind)
    return runs.where(F.col(column) >= bound)


def newest_runs(runs: DataFrame, max_runs: int = DEFAULT_MAX_RUNS) -> DataFrame:
    """The newest runs by creation time, run id breaking ties (top-k, no full sort)."""
    if max_runs < 1:
        raise ValueError(f"max_runs must be at least 1, got {max_runs}")
    return runs.orderBy(F.desc("created_at"), "run_id").limit(max_runs)


def jobs_of_runs(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Jobs whose run is listed."""
    return jobs.join(runs.select("run_id"), "run_id", "left_semi")


def every_attempt(runs: DataFrame) -> DataFrame:
    """One row per attempt: a run stores only its latest attempt number."""
    attempts = F.sequence(F.lit(1), F.greatest(F.coalesce("run_attempt", F.lit(1)), F.lit(1)))
    return runs.withColumn("run_attempt", F.explode(attempts))


def jobs_of_every_attempt(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Jobs of every attempt of the listed runs.

    The same as joining ``every_attempt``, but the range condition stands in
    for the exploded rows, so runs are not multiplied before they shuffle.
    """
    latest = F.greatest(F.coalesce("run_attempt", F.lit(1)), F.lit(1))
    listed = runs.select(F.col("run_id").alias("listed_run"), latest.alias("latest"))
    made = (F.col("run_id") == F.col("listed_run")) & F.col("run_attempt").between(F.lit(1), F.col("latest"))
    return jobs.join(listed, made, "left_semi")
