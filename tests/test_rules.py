import random

import pytest
import regex
from pyspark.sql import functions as F

from redgreen.functions.rules import RULES, java_regex, required_literals
from redgreen.functions.text import SPACE
from redgreen.operators.classify import BASELINE_NOTE, classify_by_rules, rule_hits, rule_scores
from redgreen.operators.taxonomy import CATEGORIES

TEXTS = {
    "network_timeout": "Get https://proxy: dial tcp 1.2.3.4:443: i/o timeout",
    "race_condition": "==================\nWARNING: DATA RACE\nWrite at 0x1",
    "infra_flake": "##[error]The runner has received a shutdown signal.",
    "resource_exhaustion": "write /tmp/x: No space left on device",
    "test_order_dependency": "note: test passes in isolation",
    "genuine_bug": "panic: runtime error: index out of range [3]",
    "unknown": "the build finished",
}


def classify(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, excerpt string")
    return [r.verdict for r in classify_by_rules(rows).orderBy("id").collect()]


def test_each_category(spark):
    verdicts = classify(spark, *TEXTS.values())
    assert [v.category for v in verdicts] == list(TEXTS)
    assert all(c in t for v, t in zip(verdicts, TEXTS.values()) for c in v.cited_lines)
    assert all(BASELINE_NOTE in v.explanation for v in verdicts)
    assert all(len(v.cited_lines) == 1 for v in verdicts[:-1]) and verdicts[-1].cited_lines == []


def test_table_shape():
    counts = {c.code: sum(r.category == c.code for r in RULES) for c in CATEGORIES}
    assert len(RULES) == 38 and list(counts.values()) == [7, 6, 7, 7, 6, 5, 0]
    assert all(required_literals(r.pattern) for r in RULES)


def test_confidence(spark):
    one, capped, none, tied = classify(
        spark,
        "could not resolve host",
        "WARNING: DATA RACE\nsend on closed channel\nconcurrent map write",
        "",
        "could not resolve host\nprevious write at 0x1",
    )
    assert one.confidence == pytest.approx(0.45 + 0.15 + 0.12)
    assert capped.confidence == 0.92
    assert (none.category, none.confidence) == ("unknown", 0.2)
    assert (tied.category, tied.confidence) == ("network_timeout", pytest.approx(0.60))


def test_citations_are_deduplicated_and_limited(spark):
    same, many = classify(
        spark,
        "  dial tcp 1.1.1.1: i/o timeout: connection refused \t",
        "a i/o timeout\nb dial tcp\nc connection reset by peer\nd tls handshake timeout",
    )
    assert same.cited_lines == ["dial tcp 1.1.1.1: i/o timeout: connection refused"]
    assert same.explanation == f"Matched 3 patterns for Network timeout. {BASELINE_NOTE}."
    assert many.cited_lines == ["a i/o timeout", "b dial tcp", "c connection reset by peer"]


@pytest.mark.parametrize(
    "text, hit",
    [
        ("\u00e9i/o timeout", True),  # an accented letter is no ASCII word character
        ("xi/o timeout", False),
        ("xi/o timeout\nthen i/o timeout", True),
        ("i/o timeouts", False),
        ("so\u212a\u212a no \u017fpace left on device", True),  # Kelvin sign and long s fold to ASCII
        ("out of memory\u0130", True),
        ("inval\u0130d memory address", False),  # dotted capital I does not fold to i
        ("docker daemon\u2028is not running", True),  # only a line feed ends a line
        ("docker daemon\nis not running", False),
    ],
)
def test_engine_differences(spark, text, hit):
    assert (classify(spark, text)[0].category != "unknown") is hit


def test_line_of_first_match_skips_lookalikes(spark):
    rows = spark.createDataFrame([("xi/o timeout\n  real i/o timeout \ni/o timeout",)], "excerpt string")
    hits = rule_hits(rows.withColumn("id", F.lit(1)), "id").where("rule = 0").collect()
    assert [h.line for h in hits] == ["real i/o timeout"]


def brute_force(text):
    """Rules in order through another engine, over the whole text."""
    hits = []
    for i, r in enumerate(RULES):
        m = regex.search(r.pattern.replace(r"\b", r"(?a:\b)"), text)
        if m:
            start = text.rfind("\n", 0, m.start()) + 1
            end = text.find("\n", m.start())
            hits.append((i, text[start:end if end >= 0 else len(text)].strip(SPACE)))
    return hits


def test_hits_against_brute_force(spark):
    rng = random.Random(3)
    parts = [
        "i/o timeout", "I/O Timeout", "dial tcp", "connection", "refused", "reset by peer", "no such host", "oomkilled",
        "OOM-Killed", "docker daemon", "not running", "already exists", "registry", "duplicate", "registered",
        "expected 1", "got", "but got", "previous read at 0x", "concurrent map ", "read and map write", "write", "\n",
        "\n", " ", "é", "x", "spot instance", "interrupt", "the operation was canceled", "runner", "exit code 137",
    ]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, excerpt string")
    got = sorted((r.id, r.rule, r.line) for r in rule_hits(rows, "id").collect())
    assert got == sorted((i, rule, line) for i, t in enumerate(texts) for rule, line in brute_force(t))
    assert len(got) > 150


def test_scores_and_runner_up(spark):
    rows = spark.createDataFrame([(1, "WARNING: DATA RACE\nrace detector\nout of memory"), (2, "fine")], "id int, excerpt string")
    assert [tuple(r) for r in rule_scores(rows, "id").collect()] == [(1, "race_condition", 6.0, 3.5)]


def test_java_translation_keeps_escapes():
    assert java_regex(r"(?i)a\sk[ks]") == r"(?id)a\s[k\u212A][ks]"
    assert required_literals("no flag") == [] and required_literals("(?i)a+b") == []
