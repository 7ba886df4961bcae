"""Scan, classify and evaluate: the operators in their order, as lazy plans."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redgreen.operators import detect as d
from redgreen.operators import evaluate as ev
from redgreen.operators.classify import classify_by_rules
from redgreen.operators.excerpt import ExcerptOptions, archive_excerpts, chosen_excerpts
from redgreen.operators.responses import merge_rounds, parse_responses, with_answers
from redgreen.operators.rule_table import classify_by_rule_table
from redgreen.operators.verdicts import DEFAULT_FLOOR, settle
from redgreen.sources.archives import archives_with_steps, locate_logs
from redgreen.sources.corpus import check_labels
from redgreen.sources.jobs import for_workflow


class Classifier(NamedTuple):
    """Rows with ``id, job_name, step_name, excerpt`` in, the same rows plus ``verdict, classify_error`` out.

    One that looks at nothing but the step name and the excerpt says so by
    ``by_excerpt``, and is given every excerpt once instead of every request.
    """

    name: str
    model: str
    run: Callable[[DataFrame], DataFrame]
    by_excerpt: bool = False

    @property
    def baseline(self) -> bool:
        return self.name == "deterministic"


def _by_rules(requests: DataFrame) -> DataFrame:
    return classify_by_rules(requests, "excerpt").withColumn("classify_error", F.lit(None).cast("string"))


def deterministic() -> Classifier:
    """The rule table: a narrow projection, nothing moves."""
    return Classifier("deterministic", "rule-based-v1", _by_rules, True)


def by_rule_table(rules: DataFrame, model: str = "rule-table") -> Classifier:
    """The rules of a user's table ``(rule, category, weight, pattern)``."""

    def run(requests: DataFrame) -> DataFrame:
        return classify_by_rule_table(requests, rules).withColumn("classify_error", F.lit(None).cast("string"))

    return Classifier("deterministic", model, run, True)


def from_responses(name: str, model: str, first: DataFrame, second: DataFrame, on: Sequence[str] = ("id",)) -> Classifier:
    """A classifier over landed response tables ``(id, raw, transport_error)``, with one repair round.

    ``on`` are the columns that tell requests apart: a short display id may
    repeat, so a scan of many repositories joins on ``(*by, *SIGNATURE)``.
    """

    def run(requests: DataFrame) -> DataFrame:
        rounds = [parse_responses(r).select(*on, "verdict", "malformed", "transport_error") for r in (first, second)]
        return with_answers(requests, merge_rounds(*rounds, provider=name, on=on), on)

    return Classifier(name, model, run)


def classifier(
    name: str,
    first: DataFrame | None = None,
    second: DataFrame | None = None,
    provider: str = "responses",
    model: str = "",
    on: Sequence[str] = ("id",),
) -> Classifier:
    """``deterministic``, or ``responses`` over two landed rounds joined ``on``; any other name is an error."""
    if name == "deterministic":
        return deterministic()
    if name == "responses":
        if first is None or second is None:
            raise ValueError("responses needs the tables of both rounds")
        return from_responses(provider, model, first, second, on)
    raise ValueError(f"unknown classifier {name!r} (want one of: deterministic, responses)")


def scan(
    jobs: DataFrame, workflow_file: str = "", min_attempts: int = d.MIN_ATTEMPTS, by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """``(occurrences, summary)`` of the job rows given."""
    kept = for_workflow(jobs, workflow_file)
    occurrences = d.detect(kept, min_attempts, by)
    return occurrences, d.summarise(kept, occurrences, by)


def _error(*causes: tuple[Column, Column]) -> Column:
    first = F
    for condition, message in causes:
        first = first.when(condition, message)
    return first


def classify_occurrences(
    occurrences: DataFrame,
    log_index: DataFrame,
    logs: DataFrame,
    provider: Classifier,
    floor: float = DEFAULT_FLOOR,
    options: ExcerptOptions = ExcerptOptions(),
) -> DataFrame:
    """One item per occurrence; what fails carries ``error`` and the run goes on.

    ``log_index`` is ``(job_id, log_archive)``; ``logs`` are archives listed by
    name, archives with their contents, or step rows. Of listed archives only
    names meet names: none of a healthy job is opened, and a wanted one is
    opened, scored and cut by one task. Contents and step rows are cut where
    they are read, all of them, as a join would move whole logs first; only
    excerpts, bounded by the budget, move between tasks. So list archives where
    few of them are wanted. Pass landed occurrences: listing reads them twice.
    Where many jobs share a log and its excerpt alone decides, it is classified
    where it was cut, and occurrences meet verdicts instead of texts.
    """
    failure = F.col("primary_failure")
    failing = occurrences.withColumns(
        {"job_id": failure["job_id"], "failing_url": failure["url"], "passing_url": F.col("last_pass_url")}
    )
    located = locate_logs(failing, log_index)
    if "path" in logs.columns:
        names = located.where(F.col("log_error").isNull()).select(F.col("log_archive").alias("archive"))
        logs = logs.join(names, "archive", "left_semi")
    zipped = "path" in logs.columns or "content" in logs.columns
    excerpts = chosen_excerpts(archives_with_steps(logs), options) if zipped else archive_excerpts(logs, options)
    # Occurrences without a log get a key of their own, so that they spread
    # instead of meeting in one partition under an empty name.
    key = F.when(F.col("log_error").isNull(), F.col("log_archive")).otherwise(F.concat(F.lit("\0"), "id"))
    cut = excerpts.select(
        F.col("archive").alias("key"),
        F.col("excerpt.step_name").alias("step_name"),
        F.col("excerpt.text").alias("excerpt"),
        F.col("excerpt.excerpt_bytes").alias("excerpt_len"),
        F.col("error").alias("extract_error"),
    )
    failing = located.withColumn("key", key)
    if provider.by_excerpt:
        cut = settle(provider.run(cut), floor).withColumn("excerpt", F.when(F.col("excerpt").isNotNull(), F.lit("")))
        answered = failing.join(cut, "key", "left").drop("key")
    else:
        answered = settle(provider.run(failing.join(cut, "key", "left").drop("key")), floor)
    unread = F.concat(F.lit("downloading log: reading archive "), "log_archive", F.lit(": not found"))
    error = _error(
        (failure.isNull(), F.lit("occurrence has no failing run")),
        (F.col("log_error").isNotNull(), F.concat(F.lit("downloading log: "), "log_error")),
        (F.col("extract_error").isNotNull(), F.concat(F.lit("extracting log: "), "extract_error")),
        (F.col("excerpt").isNull(), unread),
        (F.col("classify_error").isNotNull(), F.concat(F.lit("classifying: "), "classify_error")),
    )
    return answered.withColumn("error", F.coalesce(error, F.lit(""))).select(
        *occurrences.columns,
        "failing_url",
        "passing_url",
        F.when(F.col("error") == "", F.col("verdict")).alias("verdict"),
        F.coalesce("step_name", F.lit("")).alias("step_name"),
        F.coalesce("excerpt_len", F.lit(0)).alias("excerpt_len"),
        "error",
    )


def with_provenance(items: DataFrame, provider: Classifier) -> DataFrame:
    return items.withColumns(
        {"provider": F.lit(provider.name), "model": F.lit(provider.model), "baseline": F.lit(provider.baseline)}
    )


def evaluate(cases: DataFrame, provider: Classifier, floor: float = DEFAULT_FLOOR) -> DataFrame:
    """Outcomes of ``cases(id, expected_category, excerpt)``, each classified on its whole raw log.

    A label outside the closed set fails the run.
    """
    requests = check_labels(cases).withColumns({"job_name": F.lit("eval"), "step_name": F.lit("Run tests")})
    return ev.outcomes(settle(provider.run(requests), floor))
