"""Every operator as a named query over whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redgreen.functions.logs import collapse_blank_lines, step_file, strip_stamps
from redgreen.functions.text import first_sentence
from redgreen.operators import classify as c
from redgreen.operators import detect as d
from redgreen.operators import evaluate as ev
from redgreen.operators import excerpt as ex
from redgreen.operators import report as r
from redgreen.operators import responses as rs
from redgreen.operators import rule_table as rt
from redgreen.operators import taxonomy as tx
from redgreen.operators import verdicts as vd
from redgreen.plans import adapters as a
from redgreen.plans import workflow as w
from redgreen.sources import archives as ar
from redgreen.sources import corpus as co
from redgreen.sources import jobs as j
from redgreen.sources import landing as la
from redgreen.sources import results as res
from redgreen.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

STRICT_FLOOR = 0.8
HEADER = r.Header("acme/orders", "test tables", datetime(2026, 1, 2, 3, 4), "deterministic", "rule-based-v1", True)
WINDOW_AS_OF, WINDOW_DAYS, WINDOW_WORKFLOW = date(1999, 1, 1), 730, "low.yml"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def nine(column: str) -> Column:
    return F.round(column, 9).alias(column)


def digest(column: Column | str, name: str) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.md5(F.encode(value, "UTF-8")).alias(name)


# Detection


@query
def flaky_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return d.detect(a.job_results(spark, sf)).select(
        "id", "head_sha", "branch", "workflow_name", "workflow_file", "job_name", "total_attempts", "failed_runs",
        "passed_runs", nine("failure_rate"),
    )


@query
def flaky_runs(spark: SparkSession, sf: str) -> DataFrame:
    jobs = a.job_results(spark, sf)
    return d.occurrence_runs(jobs, d.detect(jobs))


@query
def primary_failures(spark: SparkSession, sf: str) -> DataFrame:
    return d.primary_failures(d.detect(a.job_results(spark, sf)))


@query
def ordered_runs(spark: SparkSession, sf: str) -> DataFrame:
    jobs = a.job_results(spark, sf)
    return d.ordered_runs(d.occurrence_runs(jobs, d.detect(jobs)))


@query
def ranked_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    ranked = d.ranked_occurrences(d.detect(a.job_results(spark, sf)))
    return ranked.select("id", "job_name", nine("failure_rate"))


@query
def index_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = j.normalise_jobs(j.index_rows(a.index_documents(spark, sf)))
    return rows.select("repo", "run_id", "run_attempt", "job_id", "job_name", "conclusion", "started_at", "log_archive")


@query
def job_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = j.normalise_jobs(j.line_rows(a.job_lines(spark, sf)))
    return rows.select("run_id", "run_attempt", "job_id", "branch", "conclusion", "started_at")


@query
def scan_summary(spark: SparkSession, sf: str) -> DataFrame:
    _, summary = w.scan(a.job_results(spark, sf))
    return summary.withColumn("mean_failure_rate", nine("mean_failure_rate"))


@query
def scan_table(spark: SparkSession, sf: str) -> DataFrame:
    return d.scan_table(d.detect(a.job_results(spark, sf)))


@query
def min_attempts_3(spark: SparkSession, sf: str) -> DataFrame:
    return d.detect(a.job_results(spark, sf), 3).select("id", "total_attempts", nine("failure_rate"))


@query
def workflow_window_scan(spark: SparkSession, sf: str) -> DataFrame:
    jobs = j.within_days(a.job_results(spark, sf), WINDOW_AS_OF, WINDOW_DAYS)
    occurrences, _ = w.scan(jobs, WINDOW_WORKFLOW)
    return occurrences.select("id", "workflow_file", "total_attempts", nine("failure_rate"))


@query
def recent_runs_cap(spark: SparkSession, sf: str) -> DataFrame:
    newest = j.newest_runs(a.runs(spark, sf))
    return j.jobs_of_runs(a.job_results(spark, sf), newest).select("run_id", "run_attempt", "job_id", "conclusion")


@query
def attempt_flattening(spark: SparkSession, sf: str) -> DataFrame:
    jobs = j.jobs_of_every_attempt(a.job_results(spark, sf), a.runs(spark, sf))
    return jobs.select("run_id", "run_attempt", "job_id")


@query
def every_attempt(spark: SparkSession, sf: str) -> DataFrame:
    return j.every_attempt(a.runs(spark, sf)).select("run_id", "run_attempt")


@query
def landed_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Summary, occurrences and runs of one scan, as they were written."""
    summary, occurrences, runs = res.land_scan(a.job_results(spark, sf), a.scratch(spark))
    rate = F.round("failure_rate", 9)
    return (
        summary.select(
            F.lit("summary").alias("kind"), F.lit("").alias("id"), F.col("total_jobs").alias("n"), F.col("distinct_commits").alias("m"),
            F.round("mean_failure_rate", 9).alias("rate"), F.lit(None).cast("string").alias("job_id"),
        )
        .union(occurrences.select(F.lit("occurrence"), "id", "total_attempts", "failed_runs", rate, "primary_failure.job_id"))
        .union(runs.select("outcome", "id", "run_id", F.col("run_attempt").cast("long"), F.lit(None).cast("double"), "job_id"))
    )


@query
def landed_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches of jobs that overlap, merged into partitions by month."""
    path = a.scratch(spark)
    for batch in a.job_batches(spark, sf):
        la.land(batch, path, period="month")
    return spark.read.parquet(path).select("run_id", "run_attempt", "job_id", "job_name", "conclusion", F.col("day").cast("string").alias("day"))


@query
def landed_detection(spark: SparkSession, sf: str) -> DataFrame:
    """Detection over a table in months and buckets, on the months of one year."""
    path = a.scratch(spark)
    landed = la.land_table(a.job_results(spark, sf), f"jobs_{uuid.uuid4().hex}", path, buckets=8, period="month")
    return d.detect(la.on_days(landed, a.months_of(spark, sf, 1996)), clean=True).select(
        "id", "workflow_file", "total_attempts", "failed_runs", nine("failure_rate"), "last_pass_url"
    )


@query
def live_detection(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences after a stream of three batches of jobs, the last one a replay, each taken up when it has landed."""
    path = a.scratch(spark)
    for n, batch in enumerate(a.job_batches(spark, sf)):
        batch.write.option("compression", la.CODEC).parquet(f"{path}/in/{n}")
        stream = spark.readStream.schema(batch.schema).option("recursiveFileLookup", True).parquet(f"{path}/in")
        live.follow(stream, f"{path}/jobs", f"{path}/out", f"{path}/checkpoint", period="month").awaitTermination()
    return live.occurrences(spark, f"{path}/out").select(
        "id", "head_sha", "branch", "workflow_name", "workflow_file", "job_name", "total_attempts", "failed_runs", nine("failure_rate")
    )


# Sources


@query
def corpus_cases(spark: SparkSession, sf: str) -> DataFrame:
    cases = co.with_log_text(co.corpus_rows(a.corpus_documents(spark, sf)), a.corpus_logs(spark, sf))
    return cases.select("id", "expected_category", "log_path", digest("excerpt", "excerpt"))


@query
def timestamp_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return a.time_texts(spark, sf).select(
        "event_id", j.parse_time("started_at").alias("parsed"), j.bad_time("started_at").alias("rejected")
    )


@query
def step_names(spark: SparkSession, sf: str) -> DataFrame:
    return a.step_file_names(spark, sf).select("p_partkey", F.inline(F.array(step_file("base"))))


@query
def normalise_lines(spark: SparkSession, sf: str) -> DataFrame:
    return a.stamped_bodies(spark, sf).select("doc_id", digest(strip_stamps("raw_body"), "body"))


@query
def archive_ingest(spark: SparkSession, sf: str) -> DataFrame:
    steps = ar.unzip_steps(a.zipped_documents(spark, sf))
    return steps.select(
        "archive", "job_dir", "step_order", "step_name", "entry_no", digest("body", "body"),
        F.col("error").isNotNull().alias("unreadable"),
    )


@query
def job_log_lookup(spark: SparkSession, sf: str) -> DataFrame:
    failures = d.primary_failures(d.detect(a.job_results(spark, sf)))
    return ar.locate_logs(failures, a.log_index(spark, sf)).select("id", "job_id", "log_archive", "log_error")


# Excerpts


@query
def blank_lines(spark: SparkSession, sf: str) -> DataFrame:
    body = collapse_blank_lines("body")
    return a.spread_blank_lines(spark, sf).select("doc_id", digest(body, "body"), F.octet_length(body).alias("bytes"))


@query
def failing_step(spark: SparkSession, sf: str) -> DataFrame:
    return ex.failing_step(a.step_logs(spark, sf)).select("archive", "step_order", "step_name", "score")


@query
def excerpt_anchor_window(spark: SparkSession, sf: str) -> DataFrame:
    return ex.anchor_window(a.step_logs(spark, sf)).select("doc_id", "anchor", digest("block", "block"))


def _excerpt(key: str, df: DataFrame) -> DataFrame:
    e = df.select(key, "excerpt.*")
    return e.select(key, "step_name", digest("text", "text"), "original_bytes", "excerpt_bytes", "truncated")


@query
def excerpt_assembled(spark: SparkSession, sf: str) -> DataFrame:
    return _excerpt("doc_id", ex.add_excerpt(a.step_logs(spark, sf)))


@query
def excerpt_small_budget(spark: SparkSession, sf: str) -> DataFrame:
    tight = ex.ExcerptOptions(max_chars=700, lines_before=4, lines_after=2, head_lines=3)
    return _excerpt("doc_id", ex.add_excerpt(a.step_logs(spark, sf), tight))


@query
def archive_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return _excerpt("archive", ex.archive_excerpts(a.step_logs(spark, sf)))


@query
def zipped_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return _excerpt("archive", ex.chosen_excerpts(ar.archives_with_steps(a.zipped_documents(spark, sf))))


# Classification


def _ruled(spark: SparkSession, sf: str) -> DataFrame:
    return c.classify_by_rules(a.step_logs(spark, sf), "body")


@query
def rule_hits(spark: SparkSession, sf: str) -> DataFrame:
    return c.rule_hits(a.step_logs(spark, sf), "doc_id", "body")


@query
def user_rule_hits(spark: SparkSession, sf: str) -> DataFrame:
    return rt.rule_table_hits(a.table(spark, sf, "documents"), "doc_id", a.phrase_rules(spark, sf), "text").select(
        "doc_id", "rule", "category", "weight", digest("line", "line")
    )


@query
def user_rule_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    docs = a.table(spark, sf, "documents")
    v = rt.classify_by_rule_table(docs, a.phrase_rules(spark, sf), "text").select("doc_id", "verdict.*")
    return v.select("doc_id", "category", nine("confidence"), F.size("cited_lines").alias("n_cited"))


@query
def rule_scores(spark: SparkSession, sf: str) -> DataFrame:
    return c.rule_scores(a.step_logs(spark, sf), "doc_id", "body")


@query
def rule_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    v = _ruled(spark, sf).select("doc_id", "verdict.*")
    return v.select("doc_id", "category", nine("confidence"), "explanation", "suggested_mitigation")


@query
def rule_citations(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.col("verdict.cited_lines")
    return _ruled(spark, sf).select(
        "doc_id", F.array_join(lines, "\n").alias("cited"), F.size(lines).alias("n_cited")
    )


@query
def confidence_floor(spark: SparkSession, sf: str) -> DataFrame:
    settled = vd.settle(_ruled(spark, sf), STRICT_FLOOR, "body")
    return settled.select(
        "doc_id", "verdict.category", "verdict.downgraded", F.coalesce("verdict.raw_category", F.lit("")).alias("raw_category")
    )


@query
def citation_check(spark: SparkSession, sf: str) -> DataFrame:
    v = vd.verify_citations(a.cited_excerpts(spark, sf)).select("doc_id", "verdict.*")
    return v.select(
        "doc_id",
        digest(F.array_join("cited_lines", "|"), "kept"),
        digest(F.array_join("hallucinated_citations", "|"), "invented"),
        F.size("cited_lines").alias("n_kept"),
        F.size("hallucinated_citations").alias("n_invented"),
    )


@query
def citation_index(spark: SparkSession, sf: str) -> DataFrame:
    """The same verdicts, checked against an index of their excerpts' lines."""
    rows = a.cited_excerpts(spark, sf)
    texts = rows.select("doc_id", "excerpt")
    checked = vd.verify_by_index(rows.select("doc_id", F.col("doc_id").alias("n"), "verdict"), vd.line_index(texts, "doc_id"), texts, "n", "doc_id")
    v = checked.select("doc_id", "verdict.*")
    return v.select(
        "doc_id",
        digest(F.array_join("cited_lines", "|"), "kept"),
        digest(F.array_join("hallucinated_citations", "|"), "invented"),
        F.size("cited_lines").alias("n_kept"),
        F.size("hallucinated_citations").alias("n_invented"),
    )


@query
def verdict_validation(spark: SparkSession, sf: str) -> DataFrame:
    return vd.with_validity(a.verdict_rows(spark, sf)).select("id", "valid", "invalid_reason")


@query
def taxonomy_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = a.verdict_rows(spark, sf).select("id", "verdict.category")
    return tx.with_taxonomy(rows).select(
        "id", "category", "label", "severity", "owner", "mitigation",
        F.array_join("mitigation_steps", "\n").alias("mitigation_steps"),
    )


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    step = F.when(F.col("form") == 0, F.lit(" \t")).otherwise(F.lit(" Run tests "))
    return a.model_responses(spark, sf).select(
        "id", "job_name", step.alias("step_name"), F.col("explanation").alias("excerpt")
    )


@query
def prompts(spark: SparkSession, sf: str) -> DataFrame:
    return rs.build_requests(_requests(spark, sf)).select("id", digest("prompt", "prompt"), digest("system", "system"))


@query
def parsed_responses(spark: SparkSession, sf: str) -> DataFrame:
    parsed = rs.parse_responses(a.first_round(spark, sf).where(F.col("raw").isNotNull()))
    v = F.col("verdict")
    return parsed.select(
        "id", F.col("malformed").isNotNull().alias("malformed"), v["category"].alias("category"),
        F.round(v["confidence"], 9).alias("confidence"), v["explanation"].alias("explanation"),
        F.array_join(v["cited_lines"], "|").alias("cited"), v["suggested_mitigation"].alias("mitigation"),
    )


@query
def repair_requests(spark: SparkSession, sf: str) -> DataFrame:
    first = rs.parse_responses(a.first_round(spark, sf))
    requests = rs.build_requests(_requests(spark, sf))
    return rs.repair_requests(requests, first).select("id", digest("prompt", "prompt"))


@query
def repair_round(spark: SparkSession, sf: str) -> DataFrame:
    landed = w.classifier("responses", first=a.first_round(spark, sf), second=a.second_round(spark, sf), provider="model")
    answered = landed.run(_requests(spark, sf))
    error = F.col("classify_error")
    kind = (
        F.when(error.isNull(), "answered")
        .when(F.startswith(error, F.lit("model returned unparseable output twice: ")), "malformed twice")
        .otherwise(error)
    )
    return answered.select("id", F.col("verdict.category").alias("category"), kind.alias("outcome"))


# Evaluation


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return w.evaluate(a.labelled_cases(spark, sf), w.deterministic())


@query
def eval_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _outcomes(spark, sf).withColumn("confidence", nine("confidence"))


@query
def case_listing(spark: SparkSession, sf: str) -> DataFrame:
    return ev.case_listing(_outcomes(spark, sf))


@query
def eval_totals(spark: SparkSession, sf: str) -> DataFrame:
    doubles = ["accuracy", "mean_confidence_correct", "mean_confidence_wrong"]
    return ev.totals(ev.cells(_outcomes(spark, sf))).withColumns({x: nine(x) for x in doubles})


@query
def eval_per_category(spark: SparkSession, sf: str) -> DataFrame:
    table = ev.per_category(ev.cells(_outcomes(spark, sf)))
    return table.withColumns({x: nine(x) for x in ["precision", "recall", "f1"]})


@query
def eval_category_order(spark: SparkSession, sf: str) -> DataFrame:
    """The categories of a scores document with their places, as written and read back."""
    p = w.deterministic()
    scores, path = ev.scores(_outcomes(spark, sf), p.name, p.model, p.baseline), a.scratch(spark)
    res.write_json(scores, path)
    back = res.read_json(spark, path, scores.schema)
    return back.select(F.posexplode("per_category").alias("place", "c")).select("place", "c.category", "c.support", F.round("c.f1", 9).alias("f1"))


@query
def eval_macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return ev.macro_f1(ev.per_category(ev.cells(_outcomes(spark, sf)))).select(nine("macro_f1"))


@query
def confusion_long(spark: SparkSession, sf: str) -> DataFrame:
    return ev.confusion(ev.cells(_outcomes(spark, sf)))


@query
def confusion_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return ev.confusion_matrix(ev.cells(_outcomes(spark, sf)))


@query
def confusion_text(spark: SparkSession, sf: str) -> DataFrame:
    return ev.confusion_text(ev.cells(_outcomes(spark, sf)))


@query
def eval_scores(spark: SparkSession, sf: str) -> DataFrame:
    p = w.deterministic()
    row = ev.scores(_outcomes(spark, sf), p.name, p.model, p.baseline)
    cell = F.col("confusion")["race_condition"]["race_condition"]
    return row.select(
        "provider", "model", "baseline", "total", "correct", nine("macro_f1"),
        F.size("per_category").alias("n_categories"), F.size("confusion").alias("n_labels"), cell.alias("race_as_race"),
    )


def _answered_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of landed responses: every fourth case labelled otherwise, some lost, some malformed twice."""
    landed = w.classifier("responses", first=a.first_round(spark, sf), second=a.second_round(spark, sf), provider="model")
    return w.evaluate(a.response_cases(spark, sf), landed)


@query
def eval_responses(spark: SparkSession, sf: str) -> DataFrame:
    doubles = ["accuracy", "mean_confidence_correct", "mean_confidence_wrong"]
    return ev.totals(ev.cells(_answered_cases(spark, sf))).withColumns({x: nine(x) for x in doubles})


@query
def response_listing(spark: SparkSession, sf: str) -> DataFrame:
    error = F.when(F.startswith("error", F.lit("model returned unparseable output twice: ")), "malformed twice")
    return ev.case_listing(_answered_cases(spark, sf)).withColumn("error", F.coalesce(error, "error"))


# Reports


def _items(spark: SparkSession, sf: str) -> DataFrame:
    cut = ex.archive_excerpts(a.step_logs(spark, sf)).select("archive", F.col("excerpt.text").alias("excerpt"))
    settled = vd.settle(c.classify_by_rules(cut), STRICT_FLOOR).drop("excerpt")
    items = a.occurrences_of_archives(settled)
    return items.withColumn("verdict", F.when(F.col("error") == "", F.col("verdict")))


@query
def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return r.category_counts(r.tally(_items(spark, sf)))


@query
def category_share(spark: SparkSession, sf: str) -> DataFrame:
    return r.category_share(r.tally(_items(spark, sf)))


@query
def detail_order(spark: SparkSession, sf: str) -> DataFrame:
    return r.ordered_detail(r.detail(_items(spark, sf)).withColumn("confidence", nine("confidence")))


@query
def issue_groups(spark: SparkSession, sf: str) -> DataFrame:
    return r.ordered_issue_groups(r.issue_groups(_items(spark, sf)).withColumn("confidence", nine("confidence")))


@query
def first_sentences(spark: SparkSession, sf: str) -> DataFrame:
    docs = a.table(spark, sf, "documents")
    return docs.select("doc_id", digest(first_sentence("text"), "sentence"))


@query
def digest_totals(spark: SparkSession, sf: str) -> DataFrame:
    return r.digest_totals(r.tally(_items(spark, sf)))


@query
def noisiest_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return r.noisiest_jobs(r.tally(_items(spark, sf)))


def _report(fmt: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return r.report_lines(_items(spark, sf), HEADER, fmt).withColumn("weight", nine("weight"))

    return run


@query
def report_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = r.json_rows(_items(spark, sf), HEADER)
    return rows.select("archive", "repo", "source", "provider", "model", "baseline", F.col("verdict.category").alias("category"), "error")


QUERIES["report_markdown"] = _report("markdown")
QUERIES["report_issue"] = _report("issue")
QUERIES["report_digest"] = _report("digest")


def repository_items(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).withColumn("repo", F.concat(F.lit("acme/"), (F.col("archive") % 5).cast("string")))


def repository_headers(spark: SparkSession) -> DataFrame:
    """Five repositories with items and one without; every second one classified by a model."""
    names = [*map(str, range(5)), "none"]
    rows = [(f"acme/{n}", f"source {n}", HEADER.generated_at, *(("model", "m1", False) if i % 2 else ("deterministic", "rule-based-v1", True))) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "repo string, source string, generated_at timestamp_ntz, provider string, model string, baseline boolean")


def _repository_report(fmt: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return r.repository_lines(repository_items(spark, sf), repository_headers(spark), fmt).withColumn("weight", nine("weight"))

    return run


QUERIES["repository_markdown"] = _repository_report("markdown")
QUERIES["repository_issue"] = _repository_report("issue")
QUERIES["repository_digest"] = _repository_report("digest")


@query
def written_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items as JSON lines, written and read back."""
    items, path = _items(spark, sf), a.scratch(spark)
    res.write_json(items, path)
    back = res.read_json(spark, path, items.schema)
    return back.select("archive", "id", F.col("verdict.category").alias("category"), F.round("verdict.confidence", 9).alias("confidence"), F.size("verdict.cited_lines").alias("n_cited"), "error")


@query
def classified_items(spark: SparkSession, sf: str) -> DataFrame:
    jobs = a.job_results(spark, sf)
    provider = w.deterministic()
    items = w.classify_occurrences(d.detect(jobs), a.log_index(spark, sf), a.named_steps(spark, sf), provider)
    return w.with_provenance(items, provider).select(
        "id", "job_name", F.col("verdict.category").alias("category"), F.round("verdict.confidence", 9).alias("confidence"),
        "step_name", "excerpt_len", "error", "provider", "model", "baseline",
    )
