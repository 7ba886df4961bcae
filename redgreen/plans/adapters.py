"""The engine's input shapes as views over the generated test tables."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redgreen.operators.taxonomy import CODES, UNKNOWN

# The log line written for each k = 0..15 and the label it stands for.
MARKED_LINES = [
    ("ERROR: dial tcp 10.0.0.7:443: i/o timeout", "network_timeout"),
    ("WARNING: DATA RACE", "race_condition"),
    ("The runner has received a shutdown signal.", "unknown"),
    ("write /tmp/out: no space left on device", "resource_exhaustion"),
    ("note: passes in isolation, leaked state from shared fixture", "test_order_dependency"),
    ("panic: runtime error: index out of range [4] with length 4", "genuine_bug"),
    ("##[error]Process completed with exit code 1.", "unknown"),
    ("all checks finished", "unknown"),
    ("context deadline exceeded; connection refused", "infra_flake"),
    ("fatal error: concurrent map read and map write", "race_condition"),
    ("spot instance scheduled for reclaim", "infra_flake"),
    ("signal: killed (exit code 137)", "resource_exhaustion"),
    ("duplicate metric in registry", "test_order_dependency"),
    ("assertion failed: expected 3 but got 4 items", "genuine_bug"),
    ("could not resolve host; previous write at 0x00c0", "race_condition"),
    ("could not resolve host and connection reset by peer", "network_timeout"),
]
STEP_NAMES = ["Set up job", "Run tests", "Upload results", "Post Run checkout"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder for a query that writes: in ``spark.checkpoint.dir``, or of this machine if Spark runs on it alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return f"{tempfile.mkdtemp(prefix='redgreen-')}/written"


def job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job executions: a line item is an attempt, its order the run and the commit."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    flag, quantity = F.col("l_returnflag"), F.col("l_quantity")
    # Text, so that keys of any size neither overflow nor collide.
    job_id = F.concat_ws("-", *[F.col(f"l_{c}").cast("string") for c in ("orderkey", "partkey", "suppkey", "linenumber")])
    conclusion = (
        F.when(flag == "A", "success")
        .when(flag == "N", "failure")
        .when(quantity < 20, "cancelled")
        .when(quantity < 35, "timed_out")
        .otherwise("skipped")
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").cast("int").alias("run_attempt"),
        job_id.alias("job_id"),
        F.concat(F.lit("job-"), "l_linestatus").alias("job_name"),
        F.concat(F.lit("Workflow "), F.col("l_linenumber").cast("string")).alias("workflow_name"),
        F.concat(F.lower(F.substring("o_orderpriority", 3, 100)), F.lit(".yml")).alias("workflow_file"),
        F.md5(F.col("l_orderkey").cast("string").cast("binary")).alias("head_sha"),
        F.col("o_orderstatus").alias("branch"),
        conclusion.alias("conclusion"),
        F.col("l_shipdate").alias("started_at"),
        F.concat(F.lit("https://ci.example/job/"), job_id).alias("url"),
        F.col("o_orderdate").alias("created_at"),
    )


def _landed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs as they land: times as text with a zone or without, some names missing.

    Their number holds the run and the attempt; it tells jobs apart as long as a run has less than ten attempts.
    """
    jobs = job_results(spark, sf_dir)
    clock = F.date_format(F.col("started_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    number = F.col("run_id") * 10 + F.col("run_attempt")
    return jobs.select(
        "run_id", "run_attempt", number.alias("job_id"), "job_name", "workflow_name", "workflow_file", "head_sha",
        F.when(F.col("branch") != "P", F.col("branch")).alias("branch"), "conclusion",
        F.when(number % 3 == 0, clock).otherwise(F.concat(clock, F.lit("Z"))).alias("started_at"), "url",
        F.concat(F.col("run_id").cast("string"), F.lit(".zip")).alias("log_archive"),
    )


def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index document per order, as text; an order has a handful of lines."""
    jobs = _landed_jobs(spark, sf_dir)
    listed = jobs.groupBy("run_id").agg(F.collect_list(F.struct(*jobs.columns)).alias("jobs"))
    text = F.to_json(F.struct(F.concat(F.lit("acme/"), (F.col("run_id") % 5).cast("string")).alias("repo"), "jobs"))
    return listed.select(F.col("run_id").cast("string").alias("file"), text.alias("document"))


def job_batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Jobs as they land in three batches: two thirds; the last two thirds, all finished as passed; the same once more."""
    jobs = job_results(spark, sf_dir).drop("created_at")
    again = jobs.where(F.col("run_id") % 3 > 0).withColumn("conclusion", F.lit("success"))
    return [jobs.where(F.col("run_id") % 3 < 2), again, again]


def months_of(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """``(day)``: first days of the months of a year in which an order was made."""
    orders = table(spark, sf_dir, "orders").where(F.year("o_orderdate") == year)
    return orders.select(F.trunc(F.to_date("o_orderdate"), "month").alias("day")).distinct()


def job_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text per job."""
    jobs = _landed_jobs(spark, sf_dir)
    return jobs.select(F.to_json(F.struct(*jobs.columns)).alias("line"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflow runs: an order, holding only its latest attempt number."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderkey") % 7).cast("int").alias("run_attempt"),
    )


def _pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def step_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step logs: four documents make one archive; each body holds its text twice around line k."""
    docs = table(spark, sf_dir, "documents")
    archive = F.floor(F.col("doc_id") / 4).cast("bigint")
    k = (F.col("doc_id") * 7 + archive) % 16
    step = F.col("doc_id") % 4
    marked = docs.select("doc_id", "text", archive.alias("archive"), k.alias("k"), step.alias("step"))
    body = F.concat(
        F.lit("$ make test\n"), "text", F.lit("\n"), _pick(F.col("k"), [x for x, _ in MARKED_LINES]), F.lit("\n"), "text"
    )
    return marked.select(
        "doc_id",
        "archive",
        F.lit(".").alias("job_dir"),
        (F.col("step") + 1).alias("step_order"),
        F.col("step").cast("int").alias("entry_no"),
        _pick(F.col("step"), STEP_NAMES).alias("step_name"),
        "k",
        body.alias("body"),
        F.lit(None).cast("string").alias("error"),
    )


def labelled_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step body as a case, labelled with the cause its line was written for (three lines mislabelled)."""
    return step_logs(spark, sf_dir).select(
        F.col("doc_id").alias("id"),
        _pick(F.col("k"), [label for _, label in MARKED_LINES]).alias("expected_category"),
        F.col("body").alias("excerpt"),
    )


def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled cases as corpora of sixteen, each a document that names its logs relative to itself."""
    cases = labelled_cases(spark, sf_dir)
    case = F.struct(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("./logs/"), F.col("id").cast("string"), F.lit(".log")).alias("log"),
        "expected_category", F.lit("").alias("note"),
    )
    listed = cases.groupBy(F.floor(F.col("id") / 16).alias("n")).agg(F.collect_list(case).alias("cases"))
    text = F.to_json(F.struct(F.lit("d").alias("description"), F.lit("p").alias("label_policy"), "cases"))
    return listed.select(F.concat(F.lit("file:/corpora/"), F.col("n").cast("string"), F.lit("/cases.json")).alias("file"), text.alias("document"))


def corpus_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(log_path, excerpt)`` of those cases."""
    n, i = F.floor(F.col("id") / 16).cast("string"), F.col("id").cast("string")
    path = F.concat(F.lit("file:/corpora/"), n, F.lit("/logs/"), i, F.lit(".log"))
    return labelled_cases(spark, sf_dir).select(path.alias("log_path"), "excerpt")


def phrase_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule table: the first three words of every document that begins with three plain ones."""
    phrase = F.regexp_extract(F.coalesce("text", F.lit("")), "^[A-Za-z]+ [A-Za-z]+ [A-Za-z]+", 0)
    docs = table(spark, sf_dir, "documents").select("doc_id", phrase.alias("phrase")).where(F.col("phrase") != "")
    first = docs.groupBy(F.lower("phrase").alias("phrase")).agg(F.min("doc_id").alias("rule"))
    return first.select(
        "rule", _pick(F.col("rule") % 6, [c for c in CODES if c != UNKNOWN]).alias("category"),
        ((F.col("rule") % 4 + 1) / F.lit(2.0)).alias("weight"), F.concat(F.lit("(?i)"), "phrase").alias("pattern"),
    )


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw responses in eight forms: bare, fenced, in prose, no JSON, bad category,
    confidence 7, unbalanced, upper-case category with blanks. Every explanation is a whole turn."""
    turns = table(spark, sf_dir, "conversations")
    category = _pick(F.col("conv_id") % 7, CODES)
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        ((F.col("conv_id") + F.col("turn")) % 8).alias("form"),
        category.alias("category"),
        ((F.col("turn") % 11) / F.lit(10.0)).alias("confidence"),
        F.coalesce("text", F.lit("")).alias("explanation"),
        F.col("role").alias("job_name"),
    )


def raw_response(form: Column) -> Column:
    """The response text of a form."""
    # The explanation as a JSON string: what follows the key of a one-field object.
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("explanation").alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)

    def obj(category: Column, confidence: Column) -> Column:
        return F.concat(
            F.lit('{"category":"'), category, F.lit('","confidence":'), confidence, F.lit(',"explanation":'),
            quoted, F.lit(',"cited_lines":["a {b} c"],"suggested_mitigation":" retry "}'),
        )

    category, confidence = F.col("category"), F.col("confidence").cast("string")
    bare = obj(category, confidence)
    return (
        F.when(form == 0, bare)
        .when(form == 1, F.concat(F.lit("Analysis:\n```json\n"), bare, F.lit("\n```\nDone.")))
        .when(form == 2, F.concat(F.lit("Sure! "), bare, F.lit(" Let me know.")))
        .when(form == 3, F.lit("I could not determine the cause."))
        .when(form == 4, obj(F.lit("cosmic_rays"), confidence))
        .when(form == 5, obj(category, F.lit("7")))
        .when(form == 6, F.left(bare, F.length(bare) - 1))
        .otherwise(obj(F.concat(F.lit("  "), F.upper(category), F.lit(" ")), confidence))
    )


def first_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First responses; every 13th request failed in transport instead."""
    rows = model_responses(spark, sf_dir)
    lost = F.col("id") % 13 == 12
    return rows.select(
        "id", "form", "job_name",
        F.when(~lost, raw_response(F.col("form"))).alias("raw"),
        F.when(lost, F.lit("connection reset")).alias("transport_error"),
    )


def second_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired responses: forms 3 and 6 come back bare, forms 4 and 5 stay malformed."""
    rows = model_responses(spark, sf_dir)
    form = F.when(F.col("form").isin(3, 6), F.lit(0)).otherwise(F.col("form"))
    return rows.select("id", raw_response(form).alias("raw"), F.lit(None).cast("string").alias("transport_error"))


def response_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as labelled cases of the responses above; every fourth label is another category."""
    label = F.when(F.col("id") % 4 == 1, F.lit(UNKNOWN)).otherwise(F.col("category"))
    return model_responses(spark, sf_dir).select("id", label.alias("expected_category"), F.col("explanation").alias("excerpt"))


def cited_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts with cited lines: two of their own, padded; one of a passage; a blank one; an invented one."""
    docs, passages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    passage = passages.select(F.col("item_id"), F.col("text").alias("passage"))
    own = F.concat(F.lit(" \t"), F.substring_index("text", "\n", 1), F.lit("\u00a0"))
    tail = F.concat(F.substring_index("text", "\n", -1), F.lit("\n"))
    lines = F.array(own, tail, F.coalesce("passage", F.lit("  ")), F.lit("   "), F.lit("an invented line"))
    verdict = F.struct(
        F.lit(UNKNOWN).alias("category"), F.lit(0.5).alias("confidence"), F.lit("x").alias("explanation"),
        lines.alias("cited_lines"), F.lit("").alias("suggested_mitigation"), F.lit(False).alias("downgraded"),
        F.lit(None).cast("string").alias("raw_category"), F.array().cast("array<string>").alias("hallucinated_citations"),
    )
    return docs.join(passage, F.col("doc_id") == F.col("item_id"), "left").select(
        "doc_id", F.col("text").alias("excerpt"), verdict.alias("verdict")
    )


def named_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step logs under the path of their archive; every thirteenth archive could not be read."""
    steps = step_logs(spark, sf_dir)
    unreadable = F.col("archive") % 13 == 6
    return steps.select(
        F.concat(F.lit("logs/"), F.col("archive").cast("string"), F.lit(".zip")).alias("archive"),
        "job_dir", "step_order", "entry_no", "step_name",
        F.when(~unreadable, F.col("body")).alias("body"),
        F.when(unreadable, F.lit("reading archive: opening log archive: not a zip")).alias("error"),
    )


def log_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(job_id, log_archive)``: failed jobs only, no archive name for every eleventh run, one that is gone for every seventh."""
    jobs = job_results(spark, sf_dir).where(F.col("conclusion") == "failure")
    archives = table(spark, sf_dir, "documents").agg(F.floor(F.count(F.lit(1)) / 4)).scalar()
    run = F.col("run_id")
    name = (
        F.when(run % 11 == 4, F.lit(""))
        .when(run % 7 == 2, F.concat(F.lit("logs/gone-"), run.cast("string"), F.lit(".zip")))
        .otherwise(F.concat(F.lit("logs/"), (run % archives).cast("string"), F.lit(".zip")))
    )
    return jobs.select("job_id", name.alias("log_archive"))


def occurrences_of_archives(archives: DataFrame) -> DataFrame:
    """Occurrence fields for every archive, and an error for each that could not be fetched."""
    a = F.col("archive")
    text = a.cast("string")
    return archives.withColumns(
        {
            "id": F.md5(text.cast("binary")),
            "job_name": F.concat(F.lit("suite-"), (a % 23).cast("string")),
            "head_sha": F.md5(F.concat(F.lit("commit "), text).cast("binary")),
            "branch": F.when(a % 2 == 0, F.lit("main")).otherwise(F.lit("dev")),
            "workflow_name": F.lit("CI"),
            "workflow_file": F.lit("ci.yml"),
            "failure_rate": (a % 7 + 1) / F.lit(8.0),
            "total_attempts": F.lit(8),
            "failing_url": F.concat(F.lit("https://ci.example/fail/"), text),
            "passing_url": F.when(a % 5 != 0, F.concat(F.lit("https://ci.example/pass/"), text)),
            "error": F.when(a % 17 == 3, F.lit("downloading log: gone")).otherwise(F.lit("")),
        }
    )


def stamped_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as runner output: CRLF line ends, a stamp on each line, then the plain text."""
    raw = F.concat(
        F.lit("2024-05-01T10:00:00.0000000Z "),
        F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n2024-05-01T10:00:01.1234567Z ")),
        F.lit("\n"),
        "text",
    )
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw_body"), "text")


def zipped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log archive per document; every tenth is unreadable."""

    # Nested, so that workers get the function itself and need no installed package.
    def zip_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents = []
            for doc_id, raw, text in zip(batch["doc_id"], batch["raw_body"], batch["text"]):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("3_Run tests.txt", raw)
                    z.writestr("build/1_Set up job.txt", text)
                    z.writestr("notes.md", "not a step")
                    z.writestr("Summary.TXT", "no number")
                contents.append(buffer.getvalue() if doc_id % 10 != 9 else b"not a zip")
            yield pd.DataFrame({"archive": batch["doc_id"].astype(str), "content": contents})

    return stamped_bodies(spark, sf_dir).mapInPandas(zip_rows, "archive string, content binary")


# Layouts the time texts cycle through.
TIME_FORMS = 6


def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as text: three accepted layouts, an offset, an empty and a rejected text."""
    form = F.col("event_id") % TIME_FORMS
    day, clock = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss.SSSSSS")
    text = (
        F.when(form == 0, F.concat(day, F.lit("T"), clock, F.lit("Z")))
        .when(form == 1, F.concat(day, F.lit("T"), clock))
        .when(form == 2, F.concat(day, F.lit(" "), clock))
        .when(form == 3, F.concat(day, F.lit("T"), clock, F.lit("+02:00")))
        .when(form == 4, F.lit(""))
        .otherwise(F.date_format("ts", "yyyy-MM"))
    )
    return table(spark, sf_dir, "events").select("event_id", text.alias("started_at"))


def step_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry names of several shapes, made from part names."""
    form = F.col("p_partkey") % 5
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    base = (
        F.when(form == 0, F.concat(size, F.lit("_"), name, F.lit(".txt")))
        .when(form == 1, F.concat(name, F.lit(".txt")))
        .when(form == 2, F.concat(F.lit("_"), name, F.lit(".txt")))
        .when(form == 3, F.concat(F.lit("+"), size, F.lit("_"), name, F.lit("_v1.2.TXT")))
        .otherwise(F.concat(F.lit("x"), size, F.lit("_"), name))
    )
    return table(spark, sf_dir, "part").select("p_partkey", base.alias("base"))


def spread_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with runs of several kinds of blank line after each sentence."""
    text = F.replace(F.col("text"), F.lit(". "), F.lit(".\n\u00a0\t\n \n\n\u3000"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("body"))


def verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all kinds: known and unknown categories, confidence from -0.2 to 1.2, blank explanations."""
    form = F.col("turn") % 4
    category = F.when(form == 3, F.lit("cosmic_rays")).otherwise(F.col("category"))
    confidence = ((F.col("id") % 15) - 2) / F.lit(10.0)
    explanation = F.when(F.col("id") % 11 == 0, F.lit("\t  ")).otherwise(F.col("explanation"))
    rows = model_responses(spark, sf_dir).withColumn("turn", F.col("id") % 1000)
    return rows.select(
        "id",
        F.struct(
            category.alias("category"), confidence.alias("confidence"), explanation.alias("explanation")
        ).alias("verdict"),
    )
