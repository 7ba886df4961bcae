"""Rollups, rankings and report texts over classified items.

An item row is ``id, job_name, head_sha, branch, workflow_name, workflow_file,
failure_rate, total_attempts, failing_url, passing_url, verdict, error``.

A report is a table of lines with a sort key, not one collected string: any
number of items is rendered where it lies, and a range sort at the sink puts
the lines in order across as many files as the data needs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redgreen.functions.text import first_sentence, percent, short_commit, two_places
from redgreen.operators.taxonomy import (
    GENUINE_BUG,
    is_category,
    label_of,
    mitigation_of,
    mitigation_steps_of,
    owner_of,
    report_order_of,
    severity_of,
)

# Texts of the reports.
BASELINE_SUFFIX = " — rule-based baseline, not a language model"
MARKDOWN_BASELINE = [
    "> [!NOTE]",
    "> These verdicts come from the deterministic rule-based baseline, not a language model. "
    "They are reproducible and free, and exist to establish the floor an LLM must beat.",
    "",
]
ISSUE_BASELINE = [
    "> Verdicts below come from the deterministic rule-based baseline, not a language model.",
    "",
]
MARKDOWN_EMPTY = "No flaky occurrences were classified."
ISSUE_EMPTY = "Nothing to action. 🎉"
DIGEST_EMPTY = "**No flaky occurrences detected.** Every job agreed with itself on every commit."
FOOTER = "<sub>Generated by redgreen.</sub>"
REPORT_TITLE = "# Flake report"
REPORT_REPOSITORY, REPORT_SOURCE = "**Repository:** `", "**Source:** "
REPORT_CLASSIFIER, REPORT_GENERATED = "**Classifier:** ", "**Generated:** "
SUMMARY_TITLE, DETAIL_TITLE = "## Summary", "## Occurrences"
SUMMARY_COUNT = " flaky occurrence(s) classified."
SHARE_TABLE = ["| Category | Count | Share | Typical owner |", "| --- | ---: | ---: | --- |"]
ITEM_COMMIT, ITEM_WORKFLOW, ITEM_RATE = "- **Commit:** `", "- **Workflow:** ", "- **Failure rate:** "
ITEM_CONFIDENCE, ITEM_DEMOTED, ITEM_DEMOTED_END = "- **Confidence:** ", "- **Note:** demoted to unknown from `", "` for low confidence"
ITEM_EVIDENCE, ITEM_MITIGATION, ITEM_OWNER = "**Evidence**", "**Mitigation** — ", " _(owner: "
ITEM_DROPPED = " cited line(s) were dropped because they do not appear in the log excerpt."
ITEM_FAILING, ITEM_PASSING, ITEM_FAILED = "[Failing run](", " · [Passing rerun](", "> Classification failed: "
ISSUE_TITLE, ISSUE_FOUND = "## Flaky tests detected in `", "Found **"
ISSUE_COUNT = " flaky occurrence(s)** — jobs that produced both a pass and a failure on the same commit."
ISSUE_CLASSIFIER = "Classified by `"
ISSUE_STEPS, ISSUE_STEPS_END = "<details><summary>Suggested steps</summary>", "</details>"
DIGEST_COUNT, DIGEST_JOBS = " flaky occurrence(s)** across **", " job(s)**."
DIGEST_BUGS = (
    " occurrence(s) look like a **genuine bug** masked by a rerun, not infrastructure noise. "
    "Those should not be re-run to green."
)
DIGEST_TABLE = ["| Category | Count |", "| --- | ---: |"]
DIGEST_NOISY = "**Noisiest jobs**"
TOP_JOBS = 5

HEADER_COLUMNS = ["repo", "source", "generated_at", "provider", "model", "baseline"]
LINE_KEY = ["part", "rank", "grp", "weight", "item", "line_no"]


@dataclass(frozen=True)
class Header:
    repo: str
    source: str
    generated_at: datetime
    provider: str
    model: str
    baseline: bool

    def label(self) -> str:
        """Names the classifier; a baseline can never pass for a model."""
        return f"{self.provider} / {self.model}" + (BASELINE_SUFFIX if self.baseline else "")


def classified(items: DataFrame) -> DataFrame:
    return items.where(F.coalesce("error", F.lit("")) == "")


def category() -> Column:
    return F.coalesce(F.col("verdict.category"), F.lit(""))


def tally(items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, category, job_name, failed, n)``: the one aggregate every rollup derives from.

    Rollups sum over it instead of filtering it, so several of them in one plan
    share a single pass over the items. All of them can be made for each value
    of ``by``, say the repository.
    """
    failed = F.coalesce("error", F.lit("")) != ""
    keys = [category().alias("category"), F.col("job_name"), failed.alias("failed")]
    return items.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("n"))


def _classified(n: str = "n") -> Column:
    return F.coalesce(F.sum(F.when(~F.col("failed"), F.col(n))), F.lit(0))


def category_counts(tally: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, category, n)``, failed items left out."""
    return tally.groupBy(*by, "category").agg(_classified().alias("n")).where(F.col("n") > 0)


def category_share(tally: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts with label, whole-percent share and owner; the window runs over one row per category."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by or [F.lit(1)]))
    return category_counts(tally, by).select(
        *by,
        report_order_of("category").alias("ord"),
        "category",
        label_of("category").alias("label"),
        "n",
        percent(share).alias("share"),
        owner_of("category").alias("owner"),
    )


def detail(items: DataFrame) -> DataFrame:
    """Fields of the detailed listing; failed items included, with severity 0."""
    v = F.col("verdict")
    return items.select(
        "id",
        "job_name",
        severity_of(category()).alias("severity"),
        F.coalesce(v["confidence"], F.lit(0.0)).alias("confidence"),
        label_of(category()).alias("label"),
        short_commit("head_sha").alias("commit"),
        percent("failure_rate").alias("fail_rate"),
        F.col("total_attempts").alias("attempts"),
        F.coalesce(v["raw_category"], F.lit("")).alias("demoted_from"),
        F.greatest(F.size(v["cited_lines"]), F.lit(0)).alias("evidence_lines"),
        F.greatest(F.size(v["hallucinated_citations"]), F.lit(0)).alias("dropped_citations"),
        "failing_url",
        "passing_url",
        F.coalesce("error", F.lit("")).alias("error"),
    )


def ordered_detail(detail: DataFrame) -> DataFrame:
    return detail.orderBy(F.desc("severity"), F.desc("confidence"), "id")


def issue_groups(items: DataFrame) -> DataFrame:
    """One row per classified item with its group's size, label, advice and sort key.

    Sizes are one row per category of the closed set, so they are broadcast,
    and no category, however large, meets in one task. Items of any other
    category, which no classifier here gives, are counted as one more group.
    """
    known = F.when(is_category("category"), F.col("category"))  # null: all others
    sizes = category_counts(tally(items)).groupBy(known.alias("_known")).agg(F.sum("n").alias("group_size"))
    rows = classified(items).withColumn("category", category())
    rows = rows.join(F.broadcast(sizes), known.eqNullSafe(F.col("_known"))).drop("_known")
    return rows.select(
        "id",
        "category",
        severity_of("category").alias("severity"),
        "group_size",
        label_of("category").alias("label"),
        mitigation_of("category").alias("mitigation"),
        "job_name",
        first_sentence(F.col("verdict.explanation")).alias("sentence"),
        short_commit("head_sha").alias("commit"),
        percent("failure_rate").alias("fail_rate"),
        F.col("verdict.confidence").alias("confidence"),
    )


def ordered_issue_groups(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("severity"), "category", F.desc("confidence"), "id")


def digest_totals(tally: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row: classified occurrences, distinct jobs, genuine bugs, and all items."""
    good = ~F.col("failed")
    return tally.groupBy(*by).agg(
        _classified().alias("occurrences"),
        F.countDistinct(F.when(good, F.col("job_name"))).alias("jobs"),
        F.coalesce(F.sum(F.when(good & (F.col("category") == GENUINE_BUG), F.col("n"))), F.lit(0)).alias("genuine_bugs"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("items"),
    )


def noisiest_jobs(tally: DataFrame, top: int = TOP_JOBS, by: Sequence[str] = ()) -> DataFrame:
    """Jobs with most occurrences, name breaking ties: combined counts, then top-k."""
    counts = tally.groupBy(*by, "job_name").agg(_classified().alias("n")).where(F.col("n") > 0)
    if not by:
        return counts.orderBy(F.desc("n"), "job_name").limit(top)
    first = Window.partitionBy(*by).orderBy(F.desc("n"), "job_name")
    return counts.withColumn("place", F.row_number().over(first)).where(F.col("place") <= top).drop("place")


def _lines(
    df: DataFrame,
    part: int,
    lines: Column,
    rank: Column | int = 0,
    grp: Column | str = "",
    weight: Column | float = 0.0,
    item: Column | str = "",
    by: Sequence[str] = (),
) -> DataFrame:
    def value(x: Column | int | float | str) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    return df.select(
        *by,
        F.lit(part).alias("part"),
        value(rank).cast("int").alias("rank"),
        value(grp).alias("grp"),
        value(weight).cast("double").alias("weight"),
        value(item).alias("item"),
        F.posexplode(lines).alias("line_no", "line"),
    )


def _texts(*values: Column | str) -> Column:
    return F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values])


def _all(*values: Column | str) -> Column:
    return F.concat(*[v if isinstance(v, Column) else F.lit(v) for v in values])


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def _totals(counted: DataFrame, header: Header | DataFrame, by: Sequence[str]) -> DataFrame:
    """``digest_totals`` under the header's texts ``repo, source, label, generated, baseline``.

    With a table of headers there is one row for each, also for those without
    items; items without a header are an error.
    """
    total = digest_totals(counted, by)
    if isinstance(header, Header):
        texts = {
            "repo": header.repo, "source": header.source, "label": header.label(),
            "generated": f"{header.generated_at:%Y-%m-%d %H:%M}", "baseline": header.baseline,
        }
        return total.withColumns({k: F.lit(v) for k, v in texts.items()})
    heads = header.select(*HEADER_COLUMNS, F.lit(True).alias("_headed"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("occurrences", "jobs", "genuine_bugs", "items")]
    missing = F.raise_error(F.concat(F.lit("no header for repository "), F.coalesce("repo", F.lit("null")))).cast("string")
    suffix = F.when(F.col("baseline"), F.lit(BASELINE_SUFFIX)).otherwise(F.lit(""))
    utc = F.to_utc_timestamp("generated_at", F.current_timezone())
    return total.join(heads, "repo", "full").select(
        F.when(F.col("_headed"), F.col("repo")).otherwise(missing).alias("repo"),
        "source",
        _all(F.col("provider"), " / ", F.col("model"), suffix).alias("label"),
        F.date_format(utc, "yyyy-MM-dd HH:mm").alias("generated"),
        "baseline",
        *counts,
    )


def _if_baseline(texts: list[str]) -> Column:
    return F.when(F.col("baseline"), _texts(*texts)).otherwise(F.array().cast("array<string>"))


def markdown_lines(items: DataFrame, header: Header | DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The full report: header, summary table, every item by severity then confidence."""
    none = F.array().cast("array<string>")
    counted = tally(items, by)
    total = _totals(counted, header, by)
    n = F.col("occurrences")
    top = F.concat(
        _texts(
            REPORT_TITLE,
            "",
            _all(REPORT_REPOSITORY, F.col("repo"), "`  "),
            _all(REPORT_SOURCE, F.col("source"), "  "),
            _all(REPORT_CLASSIFIER, F.col("label"), "  "),
            _all(REPORT_GENERATED, F.col("generated"), " UTC"),
            "",
        ),
        _if_baseline(MARKDOWN_BASELINE),
        _texts(SUMMARY_TITLE, ""),
    )
    summary = F.when(n == 0, _texts(MARKDOWN_EMPTY, "")).otherwise(
        _texts(
            _all(n.cast("string"), SUMMARY_COUNT),
            "",
            *SHARE_TABLE,
        )
    )
    share_line = _all(
        "| ", F.col("label"), " | ", F.col("n").cast("string"), " | ", F.col("share"), " | ", F.col("owner"), " |"
    )
    after_summary = F.concat(
        F.when(n > 0, _texts("")).otherwise(none), F.when(F.col("items") > 0, _texts(DETAIL_TITLE, "")).otherwise(none)
    )

    v = F.col("verdict")
    failed = F.coalesce("error", F.lit("")) != ""
    title = _all("### `", F.col("job_name"), "` — ", label_of(category()))
    cited = F.transform(v["cited_lines"], lambda x: F.rtrim(x, F.lit("\n")))
    steps = F.transform(mitigation_steps_of(category()), lambda s: F.concat(F.lit("- "), s))
    facts = F.concat(
        _texts(
            _all(ITEM_COMMIT, short_commit("head_sha"), "` on `", F.col("branch"), "`"),
            _all(ITEM_WORKFLOW, F.col("workflow_name"), " (`", F.col("workflow_file"), "`)"),
            _all(ITEM_RATE, percent("failure_rate"), " (", F.col("total_attempts").cast("string"), " attempts)"),
            _all(ITEM_CONFIDENCE, two_places(v["confidence"])),
        ),
        F.when(
            v["downgraded"],
            _texts(_all(ITEM_DEMOTED, v["raw_category"], ITEM_DEMOTED_END)),
        ).otherwise(none),
        _texts("", v["explanation"], ""),
        F.when(F.size(cited) > 0, F.concat(_texts(ITEM_EVIDENCE, "", "```"), cited, _texts("```", ""))).otherwise(none),
        F.when(
            F.size(v["hallucinated_citations"]) > 0,
            _texts(
                _all(
                    "> ",
                    F.size(v["hallucinated_citations"]).cast("string"),
                    ITEM_DROPPED,
                ),
                "",
            ),
        ).otherwise(none),
        _texts(_all(ITEM_MITIGATION, mitigation_of(category()), ITEM_OWNER, owner_of(category()), ")_"), ""),
        steps,
        _texts(""),
        F.when(
            F.col("failing_url").isNotNull(),
            _texts(
                _all(
                    ITEM_FAILING,
                    F.col("failing_url"),
                    ")",
                    F.when(
                        F.col("passing_url").isNotNull(), _all(ITEM_PASSING, F.col("passing_url"), ")")
                    ).otherwise(F.lit("")),
                ),
                "",
            ),
        ).otherwise(none),
        _texts("---", ""),
    )
    failure = _texts(_all(ITEM_FAILED, F.col("error")), "")
    body = F.concat(_texts(title, ""), F.when(failed, failure).otherwise(facts))
    severity = severity_of(category())
    confidence = F.coalesce(v["confidence"], F.lit(0.0))
    return _union(
        [
            _lines(total, 0, F.concat(top, summary), by=by),
            _lines(category_share(counted, by), 1, _texts(share_line), rank=F.col("ord"), by=by),
            _lines(total, 2, after_summary, by=by),
            _lines(items, 3, body, rank=-severity, weight=F.lit(0.0) - confidence, item=F.col("id"), by=by),
        ]
    )


def issue_lines(items: DataFrame, header: Header | DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """An issue body: items as check boxes, grouped by category, most severe group first."""
    n = F.col("occurrences")
    top = F.concat(
        _texts(
            _all(ISSUE_TITLE, F.col("repo"), "`"),
            "",
            _all(
                ISSUE_FOUND, n.cast("string"),
                ISSUE_COUNT,
            ),
            "",
            _all(ISSUE_CLASSIFIER, F.col("label"), "`."),
            "",
        ),
        _if_baseline(ISSUE_BASELINE),
    )
    end = F.when(n == 0, _texts(ISSUE_EMPTY)).otherwise(_texts("---", FOOTER))
    counted = tally(items, by)
    total = _totals(counted, header, by)
    groups = category_counts(counted, by)
    rank = -severity_of("category")
    open_group = _texts(
        _all("### ", label_of("category"), " (", F.col("n").cast("string"), ")"),
        "",
        _all("**", mitigation_of("category"), "** _(owner: ", owner_of("category"), ")_"),
        "",
    )
    close_group = F.concat(
        _texts("", ISSUE_STEPS, ""),
        F.transform(mitigation_steps_of("category"), lambda s: F.concat(F.lit("1. "), s)),
        _texts("", ISSUE_STEPS_END, ""),
    )
    rows = classified(items)
    box = _all(
        "- [ ] `", F.col("job_name"), "` — ", first_sentence(F.col("verdict.explanation")),
        " _(commit `", short_commit("head_sha"), "`, ", percent("failure_rate"), " failure rate, confidence ",
        two_places(F.col("verdict.confidence")), ")_",
    )
    return _union(
        [
            _lines(total, 0, top, by=by),
            _lines(groups, 1, open_group, rank=rank, grp=F.col("category"), weight=float("-inf"), by=by),
            _lines(
                rows, 1, _texts(box), rank=-severity_of(category()), grp=category(),
                weight=F.lit(0.0) - F.col("verdict.confidence"), item=F.col("id"), by=by,
            ),
            _lines(groups, 1, close_group, rank=rank, grp=F.col("category"), weight=float("inf"), by=by),
            _lines(total, 2, end, by=by),
        ]
    )


def digest_lines(items: DataFrame, header: Header | DataFrame, window_days: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """The short periodic summary: totals, category table, noisiest jobs."""
    none = F.array().cast("array<string>")
    n, bugs = F.col("occurrences"), F.col("genuine_bugs")
    top = _texts(
        f"## Flake digest — last {window_days} days",
        "",
        _all("`", F.col("repo"), "` · classified by ", F.col("label")),
        "",
    )
    found = F.concat(
        _texts(
            _all(
                "**", n.cast("string"), DIGEST_COUNT, F.col("jobs").cast("string"), DIGEST_JOBS
            ),
            "",
        ),
        F.when(
            bugs > 0,
            _texts(
                _all(
                    "> ⚠️ ", bugs.cast("string"),
                    DIGEST_BUGS,
                ),
                "",
            ),
        ).otherwise(none),
        _texts(*DIGEST_TABLE),
    )
    counted = tally(items, by)
    total = _totals(counted, header, by)
    row = _all("| ", F.col("label"), " | ", F.col("n").cast("string"), " |")
    place = F.row_number().over(Window.partitionBy(*by or [F.lit(1)]).orderBy(F.desc("n"), "job_name"))
    noisy = noisiest_jobs(counted, by=by).withColumn("place", place)
    job_line = _all(
        F.col("place").cast("string"), ". `", F.col("job_name"), "` — ", F.col("n").cast("string"), " occurrence(s)"
    )
    return _union(
        [
            _lines(total, 0, F.concat(top, F.when(n == 0, _texts(DIGEST_EMPTY)).otherwise(found)), by=by),
            _lines(category_share(counted, by), 1, _texts(row), rank=F.col("ord"), by=by),
            _lines(total, 2, F.when(n > 0, _texts("", DIGEST_NOISY, "")).otherwise(none), by=by),
            _lines(noisy, 3, _texts(job_line), rank=F.col("place"), by=by),
            _lines(total, 4, F.when(n > 0, _texts("", FOOTER)).otherwise(none), by=by),
        ]
    )


def report_lines(
    items: DataFrame, header: Header | DataFrame, fmt: str = "markdown", window_days: int = 7, by: Sequence[str] = ()
) -> DataFrame:
    """Lines of one report format, unsorted, with their sort key."""
    if fmt in ("markdown", "md"):
        return markdown_lines(items, header, by)
    if fmt == "issue":
        return issue_lines(items, header, by)
    if fmt == "digest":
        return digest_lines(items, header, window_days, by)
    raise ValueError(f"unknown report format {fmt!r} (want markdown, json, issue, or digest)")


def repository_lines(items: DataFrame, headers: DataFrame, fmt: str = "markdown", window_days: int = 7) -> DataFrame:
    """Lines of one report for each row of ``headers``, with ``repo`` before the sort key.

    ``headers`` has the columns of ``Header``, one row per repository; ``items``
    has a column ``repo`` too. All reports come from the same few aggregates.
    """
    return report_lines(items, headers, fmt, window_days, by=["repo"])


def in_reading_order(lines: DataFrame) -> DataFrame:
    """Lines by report, if there are several, and place; a range sort, so a long report spreads over tasks."""
    by = [c for c in lines.columns if c not in (*LINE_KEY, "line")]
    return lines.orderBy(*by, *LINE_KEY).select(*by, "line")


def json_rows(items: DataFrame, header: Header | DataFrame) -> DataFrame:
    """The ``json`` format: items under the header's columns, or under those of their repository."""
    if isinstance(header, Header):
        return items.withColumns({k: F.lit(v) for k, v in asdict(header).items()})
    return items.join(header.select(*HEADER_COLUMNS), "repo")


def write_report(
    items: DataFrame, header: Header, path: str, fmt: str = "markdown", window_days: int = 7
) -> None:
    """Text files whose name order is reading order; ``json`` writes the items under the header's columns."""
    if fmt == "json":
        json_rows(items, header).write.mode("errorifexists").json(path)
    else:
        in_reading_order(report_lines(items, header, fmt, window_days)).write.mode("errorifexists").text(path)


def write_reports(items: DataFrame, headers: DataFrame, path: str, fmt: str = "markdown", window_days: int = 7) -> None:
    """One folder ``repo=...`` for each row of ``headers``, in one job; in each, name order is reading order."""
    if fmt == "json":
        json_rows(items, headers).write.mode("errorifexists").partitionBy("repo").json(path)
    else:
        lines = in_reading_order(repository_lines(items, headers, fmt, window_days))
        lines.write.mode("errorifexists").partitionBy("repo").text(path)
