import random

import pytest
from pyspark.sql import functions as F

from redgreen.functions.logs import ANCHOR_MARKERS, DROPPED_HEAD, ELISION, FAILURE_MARKERS, failure_score
from redgreen.functions.text import SPACE
from redgreen.operators.excerpt import ExcerptOptions, add_excerpt, anchor_window, archive_excerpts, failing_step

STEPS = "archive string, job_dir string, step_order bigint, step_name string, entry_no int, body string, error string"


def steps(spark, *rows):
    """Rows of (archive, folder, order, name, body)."""
    return spark.createDataFrame([(a, d, o, n, i, b, None) for i, (a, d, o, n, b) in enumerate(rows)], STEPS)


def score(name, body):
    name, body = name.lower(), body.lower()
    if name.startswith("post ") or name == "complete job":
        return 0
    return sum(len(FAILURE_MARKERS) - i for i, m in enumerate(FAILURE_MARKERS) if m in body)


def excerpt(body, o):
    """Brute force over line lists."""
    lines, blank = [], False
    for line in body.split("\n"):
        empty = line.strip(SPACE) == ""
        if not (empty and blank):
            lines.append(line)
        blank = empty
    collapsed = "\n".join(lines)
    anchors = [i for i, x in enumerate(lines) if any(m in x.lower() for m in ANCHOR_MARKERS)]
    block = collapsed
    if anchors:
        block = "\n".join(lines[max(0, anchors[-1] - o.lines_before):anchors[-1] + o.lines_after + 1])
    head = "\n".join(lines[:o.head_lines]) if 0 < o.head_lines < len(lines) else ""
    text = head + ELISION + block if head and head not in block else block
    truncated = len(text.encode()) < len(collapsed.encode())
    if len(text.encode()) > o.max_chars:
        truncated = True
        if len(text) > o.max_chars:
            text = DROPPED_HEAD + text[-o.max_chars:]
    return text, len(body.encode()), len(text.encode()), truncated


def test_specific_markers_weigh_more(value):
    assert value(failure_score(F.lit("Run"), "x"), x="##[error] x") == 11
    assert value(failure_score(F.lit("Run"), "x"), x="an EXCEPTION") == 1
    assert value(failure_score(F.lit("Run"), "x"), x="all good") == 0
    assert value(failure_score(F.lit("Post Run"), "x"), x="##[error]") == 0
    assert value(failure_score(F.lit("Complete job"), "x"), x="##[error]") == 0


def test_step_choice(spark):
    rows = steps(
        spark,
        ("best", ".", 1, "Build", "ok"), ("best", ".", 2, "Test", "--- FAIL: x\nerror: y"),
        ("best", ".", 3, "Upload", "timeout"), ("best", ".", 4, "Post Checkout", "##[error] panic: failed"),
        ("tie", ".", 1, "One", "error: a"), ("tie", ".", 2, "Two", "error: b"),
        ("none", ".", 1, "One", "fine"), ("none", ".", 9, "Complete job", "##[error] cleanup"),
        ("dirs", "b", 1, "Late folder", "error: a"), ("dirs", "a", 7, "Early folder", "error: b"),
        ("same", ".", 0, "first", "error: a"), ("same", ".", 0, "second", "error: b"),
    )
    chosen = {r.archive: r.step_name for r in failing_step(rows).collect()}
    assert chosen == {"best": "Test", "tie": "Two", "none": "Complete job", "dirs": "Late folder", "same": "second"}


def test_anchor_and_command_survive(spark):
    body = "\n".join(["$ make test", *[f"line {i}" for i in range(400)], "panic: boom", "summary"])
    row = add_excerpt(steps(spark, ("a", ".", 1, "Run", body))).first().excerpt
    assert row.text.startswith("$ make test\n") and "panic: boom\nsummary" in row.text
    assert ELISION in row.text and "line 100" not in row.text and row.truncated
    assert row.step_name == "Run" and row.original_bytes == len(body)


def test_short_log_stays_whole(spark):
    row = add_excerpt(steps(spark, ("a", ".", 1, "Run", "go test\nFAIL"))).first().excerpt
    assert (row.text, row.truncated, row.excerpt_bytes) == ("go test\nFAIL", False, 12)


def test_last_anchor_wins(spark):
    body = "\n".join(["x"] * 3 + ["PANIC: one"] + ["y"] * 10 + ["Assertion Failed"] + ["z"] * 3)
    row = anchor_window(steps(spark, ("a", ".", 1, "Run", body)), ExcerptOptions(lines_before=1, lines_after=1)).first()
    assert (row.anchor, row.block) == (14, "y\nAssertion Failed\nz")


def test_no_budget_means_defaults():
    assert ExcerptOptions(max_chars=0, lines_before=1).effective() == ExcerptOptions()
    assert ExcerptOptions(max_chars=5, lines_before=1).effective().lines_before == 1


OPTIONS = [
    ExcerptOptions(),
    ExcerptOptions(max_chars=60, lines_before=2, lines_after=1, head_lines=2),
    ExcerptOptions(max_chars=150, lines_before=0, lines_after=0, head_lines=0),
    ExcerptOptions(max_chars=90, lines_before=3, lines_after=4, head_lines=5),
]


@pytest.mark.parametrize("options", OPTIONS)
def test_excerpts_against_brute_force(spark, options):
    rng = random.Random(11)
    pieces = ["ok", "", " ", "Fatal Error: x", "panic: y", "é" * 9, "warning", "🎉 done", "##[error] z", "data race", "\t"]
    bodies = ["\n".join(rng.choice(pieces[:rng.randint(1, 11)]) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    rows = add_excerpt(steps(spark, *[(str(i), ".", 1, "Run", b) for i, b in enumerate(bodies)]), options).collect()
    for r in rows:
        e = r.excerpt
        assert (e.text, e.original_bytes, e.excerpt_bytes, e.truncated) == excerpt(r.body, options)


def test_archive_excerpts_against_brute_force(spark):
    rng = random.Random(5)
    words = ["ok", "error: a", "failed", "timeout", "panic: b", "assertion"]
    rows = [
        (f"a{i}", rng.choice("xy"), rng.randint(0, 3), rng.choice(["Run", "Post Run", "Build"]),
         "\n".join(rng.choice(words) for _ in range(rng.randint(1, 3))))
        for i in range(40) for _ in range(rng.randint(1, 6))
    ]
    got = {r.archive: r.excerpt.text for r in archive_excerpts(steps(spark, *rows)).collect()}
    for archive in {r[0] for r in rows}:
        own = [(score(n, b), d, o, i, b) for i, (a, d, o, n, b) in enumerate(rows) if a == archive]
        assert got[archive] == excerpt(max(own)[4], ExcerptOptions())[0]


def test_unreadable_archive_keeps_its_error(spark):
    broken = spark.createDataFrame([("bad", None, None, None, None, None, "opening log archive: x")], STEPS)
    row = archive_excerpts(broken.unionByName(steps(spark, ("ok", ".", 1, "Run", "x")))).orderBy("archive").collect()
    assert (row[0].excerpt, row[0].error) == (None, "opening log archive: x")
    assert row[1].excerpt.text == "x" and row[1].error is None


def test_a_hot_archive_is_combined_where_it_lies(spark):
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("a"), F.col("id").cast("string"))).alias("archive"),
        F.lit(".").alias("job_dir"), F.col("id").alias("step_order"), F.lit("Run").alias("step_name"),
        F.lit(0).alias("entry_no"),
        F.when(F.col("id") % 1000 == 7, F.lit("panic: x")).otherwise(F.lit("error: y")).alias("body"),
        F.lit(None).cast("string").alias("error"),
    )
    got = {r.archive: r.excerpt.text for r in archive_excerpts(rows).where("archive in ('hot', 'a3')").collect()}
    assert got == {"hot": "panic: x", "a3": "error: y"}
    assert failing_step(rows).where("archive = 'hot'").first().step_order == 19007
