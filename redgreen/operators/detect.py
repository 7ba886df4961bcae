"""Flaky-job detection: a signature that both passed and failed on one commit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redgreen.functions.text import percent, short_commit, short_hash, text_or_empty

# Conclusions that say something about the code.
DECISIVE = ["success", "failure", "timed_out"]
PASSED = "success"
MIN_ATTEMPTS = 2

SIGNATURE = ["head_sha", "workflow_file", "job_name"]
# Attempts of a signature order by start time, a missing one first, then by ids.
ATTEMPT_ORDER = ["started_at", "run_id", "run_attempt", "job_id"]


def passed() -> Column:
    return F.col("conclusion") == PASSED


def decisive_jobs(jobs: DataFrame, clean: bool = False) -> DataFrame:
    """Rows that count: a decisive conclusion, a commit and a job name.

    Of ``clean`` rows no key is null, and their columns are taken as they are,
    so that the engine still knows how a landed table is bucketed.
    """
    kept = jobs.where(F.col("conclusion").isin(DECISIVE) & (F.col("head_sha") != "") & (F.col("job_name") != ""))
    return kept if clean else kept.withColumn("workflow_file", text_or_empty("workflow_file"))


def detect(jobs: DataFrame, min_attempts: int = MIN_ATTEMPTS, by: Sequence[str] = (), clean: bool = False) -> DataFrame:
    """One row per flaky occurrence, within each value of ``by`` (say the repository).

    Counts come first, in a hash aggregate whose buffers have a fixed size, so
    a signature holding a third of all attempts costs one row per map task and
    no job row is sorted. Only attempts of the few flaky signatures then meet
    for their first attempt, latest failure and last pass; those need texts in
    the buffer, for which the engine sorts. What a caller does not select (say
    ``primary_failure``) is pruned from it. Attempts are never collected.

    Columns: ``id, head_sha, branch, workflow_name, workflow_file, job_name,
    total_attempts, failed_runs, passed_runs`` (counts), ``failure_rate,
    primary_failure`` (the latest failed run) and ``last_pass_url``. The runs
    themselves are the child rows of ``occurrence_runs``.
    """
    keys = [*by, *SIGNATURE]
    rows = decisive_jobs(jobs, clean)
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_attempts"), F.count_if(~passed()).alias("failed_runs")
    )
    counted = counts.where(
        (F.col("total_attempts") >= max(MIN_ATTEMPTS, min_attempts))
        & (F.col("failed_runs") > 0)
        & (F.col("failed_runs") < F.col("total_attempts"))
    )
    failed_run = F.when(~passed(), F.struct(*ATTEMPT_ORDER, "conclusion", "url"))
    passed_run = F.when(passed(), F.struct(*ATTEMPT_ORDER, "url"))
    # A null in ``by`` is a value like any other.
    listed = counted.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) if k in by else F.col(k) == F.col(f"_{k}") for k in keys])
    details = rows.join(listed, same, "left_semi").groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.min(F.struct(*ATTEMPT_ORDER, "branch", "workflow_name")).alias("first"),
        F.max(failed_run).alias("primary_failure"),
        F.max(passed_run)["url"].alias("last_pass_url"),
    )
    flaky = counted.join(details, same)
    return flaky.select(
        *by,
        short_hash(*SIGNATURE).alias("id"),
        "head_sha",
        "first.branch",
        "first.workflow_name",
        "workflow_file",
        "job_name",
        "total_attempts",
        "failed_runs",
        (F.col("total_attempts") - F.col("failed_runs")).alias("passed_runs"),
        (F.col("failed_runs") / F.col("total_attempts")).alias("failure_rate"),
        "primary_failure",
        "last_pass_url",
    )


def occurrence_runs(jobs: DataFrame, occurrences: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Failed and passed runs of every occurrence, one row per attempt.

    The id is a hash of the signature, so nothing but membership is needed from
    the occurrences. A hot signature skews only the job side, which adaptive
    execution splits. Sort with ``ordered_runs`` where the order has to show.
    """
    outcome = F.when(passed(), F.lit("passed")).otherwise(F.lit("failed"))
    keys = [*by, *SIGNATURE]
    return decisive_jobs(jobs).join(occurrences.select(*keys), keys, "left_semi").select(
        *by,
        short_hash(*SIGNATURE).alias("id"),
        outcome.alias("outcome"),
        *["run_id", "run_attempt", "job_id", "conclusion", "started_at", "url"],
    )


def ordered_runs(runs: DataFrame) -> DataFrame:
    """Attempts of an occurrence in time order, failed before passed.

    A range sort on the whole key: even one occurrence spreads over many tasks.
    """
    return runs.orderBy("id", "outcome", *ATTEMPT_ORDER)


def ranked_occurrences(occurrences: DataFrame) -> DataFrame:
    """Flakiest first, then job name and id; for sinks only."""
    return occurrences.orderBy(F.desc("failure_rate"), "job_name", "id")


def primary_failures(occurrences: DataFrame) -> DataFrame:
    """``(id, job_name, run_id, run_attempt, job_id, started_at, url)`` of the latest failed run."""
    failure = [F.col("primary_failure")[f].alias(f) for f in ("run_id", "run_attempt", "job_id", "started_at", "url")]
    return occurrences.select("id", "job_name", *failure)


def signatures(jobs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per signature of all jobs: ``jobs`` counts every row, ``total_attempts`` and ``failed_runs`` those that count.

    What a scan reports of all jobs and which signatures are flaky both follow
    from it, so one pass over the jobs serves both.
    """
    counts = F.col("conclusion").isin(DECISIVE) & (F.col("head_sha") != "") & (F.col("job_name") != "")
    rows = jobs.withColumns({"workflow_file": text_or_empty("workflow_file"), "_counts": F.coalesce(counts, F.lit(False))})
    return rows.groupBy(*by, *SIGNATURE).agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if("_counts").alias("total_attempts"),
        F.count_if(F.col("_counts") & ~passed()).alias("failed_runs"),
    )


def flaky_signatures(signatures: DataFrame, min_attempts: int = MIN_ATTEMPTS) -> DataFrame:
    """Those that both passed and failed, in enough attempts."""
    return signatures.where(
        (F.col("total_attempts") >= max(MIN_ATTEMPTS, min_attempts))
        & (F.col("failed_runs") > 0)
        & (F.col("failed_runs") < F.col("total_attempts"))
    )


def scanned(signatures: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``total_jobs``, ``distinct_commits``, and the sums of attempts, per value of ``by``, from the signatures of all jobs."""
    return signatures.groupBy(*by).agg(
        F.coalesce(F.sum("jobs"), F.lit(0)).alias("total_jobs"),
        F.countDistinct(F.nullif("head_sha", F.lit(""))).alias("distinct_commits"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_attempts", "failed_runs")],
    )


def attempts_of(jobs: DataFrame, flaky: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Whole rows of the attempts that count of some signatures."""
    keys = [*by, *SIGNATURE]
    listed = flaky.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) if k in by else F.col(k) == F.col(f"_{k}") for k in keys])
    columns = [*by, *SIGNATURE, *ATTEMPT_ORDER, "branch", "workflow_name", "conclusion", "url"]
    return decisive_jobs(jobs).join(listed, same, "left_semi").select(*columns)


def occurrences_of(attempts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What ``detect`` gives, from the attempts of flaky signatures alone."""
    failed_run = F.when(~passed(), F.struct(*ATTEMPT_ORDER, "conclusion", "url"))
    passed_run = F.when(passed(), F.struct(*ATTEMPT_ORDER, "url"))
    found = attempts.groupBy(*by, *SIGNATURE).agg(
        F.count(F.lit(1)).alias("total_attempts"),
        F.count_if(~passed()).alias("failed_runs"),
        F.min(F.struct(*ATTEMPT_ORDER, "branch", "workflow_name")).alias("first"),
        F.max(failed_run).alias("primary_failure"),
        F.max(passed_run)["url"].alias("last_pass_url"),
    )
    return found.select(
        *by,
        short_hash(*SIGNATURE).alias("id"),
        "head_sha",
        "first.branch",
        "first.workflow_name",
        "workflow_file",
        "job_name",
        "total_attempts",
        "failed_runs",
        (F.col("total_attempts") - F.col("failed_runs")).alias("passed_runs"),
        (F.col("failed_runs") / F.col("total_attempts")).alias("failure_rate"),
        "primary_failure",
        "last_pass_url",
    )


def runs_of(attempts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What ``occurrence_runs`` gives, from the attempts of flaky signatures alone."""
    outcome = F.when(passed(), F.lit("passed")).otherwise(F.lit("failed"))
    return attempts.select(
        *by, short_hash(*SIGNATURE).alias("id"), outcome.alias("outcome"), "run_id", "run_attempt", "job_id", "conclusion", "started_at", "url"
    )


def summarise(jobs: DataFrame, occurrences: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row of totals per value of ``by``; counts every job row, decisive or not.

    Two global aggregates of one row each meet in a union, not a join.
    """
    scanned = jobs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.countDistinct(F.nullif("head_sha", F.lit(""))).alias("distinct_commits"),
    )
    return with_flaky(scanned, occurrences, by)


def with_flaky(scanned: DataFrame, occurrences: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A summary from the totals of all jobs and the occurrences."""
    flaky = occurrences.groupBy(*by).agg(
        F.count(F.lit(1)).alias("flaky_occurrences"),
        F.countDistinct("job_name").alias("affected_jobs"),
        F.avg("failure_rate").alias("mean_failure_rate"),
    )
    both = scanned.unionByName(flaky, allowMissingColumns=True)
    counts = ["total_jobs", "distinct_commits", "flaky_occurrences", "affected_jobs"]
    return both.groupBy(*by).agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in counts],
        F.coalesce(F.max("mean_failure_rate"), F.lit(0.0)).alias("mean_failure_rate"),
    )


def scan_table(occurrences: DataFrame) -> DataFrame:
    """The listing a scan prints: short commit and whole-percent failure rate."""
    return occurrences.select(
        "id",
        "job_name",
        short_commit("head_sha").alias("commit"),
        "workflow_file",
        percent("failure_rate").alias("fail_rate"),
        F.col("total_attempts").alias("attempts"),
    )
