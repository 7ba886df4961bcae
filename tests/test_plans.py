"""What the physical plans must and must not hold."""

import os
import re
import zipfile

import pytest

from redgreen.operators import detect as d
from redgreen.plans import adapters as a
from redgreen.plans import workflow as w
from redgreen.plans.catalog import QUERIES
from redgreen.sources import archives as ar

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


def plan(df, final=False):
    if final:
        df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("\n+- == Initial Plan ==")[0]  # not those of subqueries, which are indented


@pytest.mark.parametrize("name", QUERIES)
def test_no_query_pairs_rows_without_a_key(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # Seven lines of an order, sixteen cases of a corpus, the lines that one verdict cites.
    assert "collect_list" not in text or name in ("eval_scores", "index_documents", "corpus_cases", "citation_index")
    # Python runs only to unzip, and to search for the rules of a table.
    assert ("EvalPython" in text) == name.startswith("user_rule_")
    assert ("MapInPandas" in text) == (name in ("archive_ingest", "zipped_excerpts"))


def test_no_job_row_is_sorted_to_count_it(spark):
    """Sorting aggregates stand above the semi join with flaky signatures only."""
    text = plan(QUERIES["flaky_occurrences"](spark, SF_DIR))
    assert "HashAggregate" in text and "partial_count" in text
    for node in re.findall(r"SortAggregate\([^\n]*", text):
        assert "partial_min(struct" in node or "min(struct" in node or "max(" in node
    below = text[text.index("partial_min(struct"):].split("HashAggregate")[0]
    assert "LeftSemi" in below


def moved_columns(df):
    """Column names of every exchange and sort, in the plan as first made."""
    seen = []

    def walk(node):
        if node.nodeName().startswith(("Exchange", "Sort")):
            output = node.output()
            seen.append({output.apply(i).name() for i in range(output.size())})
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan().initialPlan())
    return seen


def test_no_exchange_moves_a_log(spark, tmp_path):
    """Even without broadcasts no body, content or step is shuffled or sorted: names meet names, excerpts meet names."""
    with zipfile.ZipFile(tmp_path / "1.zip", "w") as z:
        z.writestr("1_a.txt", "x")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        jobs, index = a.job_results(spark, SF_DIR), a.log_index(spark, SF_DIR)
        forms = [ar.list_archives(spark, str(tmp_path)), ar.read_archives(spark, str(tmp_path)), a.named_steps(spark, SF_DIR)]
        for logs in forms:
            seen = moved_columns(w.classify_occurrences(d.detect(jobs), index, logs, w.deterministic()))
            assert seen and not any({"body", "content", "text", "steps", "raw_body"} & names for names in seen)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_listed_archives_are_filtered_before_they_are_opened(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "1.zip", "w") as z:
        z.writestr("1_a.txt", "x")
    index, jobs = a.log_index(spark, SF_DIR), a.job_results(spark, SF_DIR)
    df = w.classify_occurrences(d.detect(jobs), index, ar.list_archives(spark, str(tmp_path)), w.deterministic())
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"MapInPandas[^\n]*\n[^\n]*RepartitionByExpression[^\n]*\n(?:[^\n]*Project[^\n]*\n)?[^\n]*Join LeftSemi", text)
    assert "content" not in "".join(re.findall(r"FileScan binaryFile[^\n]*", plan(df)))


def test_building_a_plan_runs_nothing(spark):
    """Given its inputs (whose files are read for their schemas), no operator starts a job."""
    jobs, index, logs = a.job_results(spark, SF_DIR), a.log_index(spark, SF_DIR), a.named_steps(spark, SF_DIR)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "no job may start")
    try:
        occurrences, _ = w.scan(jobs)
        w.classify_occurrences(occurrences, index, logs, w.deterministic())
        assert list(tracker.getJobIdsForGroup("plan-only")) == []
    finally:
        spark.sparkContext.setJobGroup("tests", "")


def test_an_archive_with_its_steps_is_cut_without_a_shuffle(spark):
    text = plan(QUERIES["zipped_excerpts"](spark, SF_DIR))
    assert "Exchange" not in text and "Sort" not in text and "Aggregate" not in text


def test_choosing_a_step_ranks_no_body(spark):
    """No aggregate sorts; each task passes on one step per archive, without its body."""
    df = QUERIES["failing_step"](spark, SF_DIR)
    assert "SortAggregate" not in plan(df) and "WindowGroupLimit" in plan(df)
    assert not any({"body", "text"} & names for names in moved_columns(df))


def test_group_sizes_are_broadcast(spark):
    text = plan(QUERIES["issue_groups"](spark, SF_DIR))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_every_cause_and_most_categories_occur(spark):
    rows = QUERIES["classified_items"](spark, SF_DIR).select("category", "error").collect()
    errors = {" ".join(r.error.split(" ")[:2]) for r in rows}
    assert {"downloading log:", "extracting log:", ""} <= errors
    assert any(r.error.endswith("has no log archive") for r in rows) and any(r.error.endswith("not found") for r in rows)
    assert len({r.category for r in rows if not r.error}) >= 4
    assert sum(not r.error for r in rows) > len(rows) / 2


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(QUERIES["workflow_window_scan"](spark, SF_DIR))
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(o_orderdate", text)
    assert "l_extendedprice" not in text and "o_totalprice" not in text


def test_logs_are_cut_before_they_move(spark):
    """The last shuffle over step rows carries excerpts by archive, never bodies."""
    text = plan(QUERIES["archive_excerpts"](spark, SF_DIR))
    shuffles = [line for line in text.split("\n") if "Exchange hashpartitioning" in line and "ENSURE" in line]
    assert len(shuffles) == 1
    assert "partial_max_by(excerpt" in text


def test_report_shares_one_tally(spark):
    assert plan(QUERIES["report_markdown"](spark, SF_DIR), final=True).count("ReusedExchange") >= 2
