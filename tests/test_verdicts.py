import random

import pytest
from pyspark.sql import functions as F

from redgreen.operators import taxonomy as tx
from redgreen.operators import verdicts as v
from redgreen.schemas import VERDICT


def verdict(category="infra_flake", confidence=0.6, explanation="x", cited=()):
    return (category, confidence, explanation, list(cited), "do", False, None, [])


def frame(spark, *rows, excerpt="alpha line\nbeta line"):
    return spark.createDataFrame([(i, r, excerpt) for i, r in enumerate(rows)], f"id int, verdict {VERDICT}, excerpt string")


@pytest.mark.parametrize(
    "row, reason",
    [
        (verdict(), None),
        (verdict(confidence=0.0), None),
        (verdict(confidence=1.0), None),
        (verdict(category="cosmic_rays"), "unknown category cosmic_rays"),
        (verdict(category="Infra_Flake"), "unknown category Infra_Flake"),
        (verdict(confidence=1.01), "confidence 1.010 outside [0,1]"),
        (verdict(confidence=-0.1), "confidence -0.100 outside [0,1]"),
        (verdict(explanation="  \t"), "empty explanation"),
        (verdict(category="x", confidence=9.0, explanation=""), "unknown category x"),
    ],
)
def test_validity(spark, row, reason):
    got = v.with_validity(frame(spark, row)).first()
    assert (got.valid, got.invalid_reason) == (reason is None, reason)


def test_floor(spark):
    rows = [verdict(confidence=0.49), verdict(confidence=0.5), verdict("unknown", 0.1)]
    low, edge, unknown = [r.verdict for r in v.apply_floor(frame(spark, *rows)).orderBy("id").collect()]
    assert (low.category, low.raw_category, low.downgraded, low.confidence) == ("unknown", "infra_flake", True, 0.49)
    assert (edge.category, edge.raw_category, edge.downgraded) == ("infra_flake", None, False)
    assert (unknown.category, unknown.downgraded) == ("unknown", False)
    with pytest.raises(ValueError):
        v.apply_floor(frame(spark, *rows), 1.5)


def test_citations(spark):
    row = verdict(cited=["  alpha line ", "alpha", "gamma", " ", "line\nbeta", "BETA"])
    got = v.verify_citations(frame(spark, row)).first().verdict
    assert got.cited_lines == ["  alpha line ", "alpha", "line\nbeta"]
    assert got.hallucinated_citations == ["gamma", "BETA"]
    assert got.explanation == "x" and got.confidence == 0.6


def test_missing_verdicts_and_excerpts_pass_through(spark):
    rows = frame(spark, None, verdict(cited=["a"]), excerpt=None)
    none, lost = [r.verdict for r in v.settle(rows).orderBy("id").collect()]
    assert none is None
    assert (lost.cited_lines, lost.hallucinated_citations) == ([], ["a"])


def test_citations_are_checked_before_the_floor(spark):
    got = v.settle(frame(spark, verdict(confidence=0.1, cited=["gamma"]))).first().verdict
    assert (got.category, got.hallucinated_citations) == ("unknown", ["gamma"])


def test_taxonomy_is_complete(spark):
    rows = spark.createDataFrame([(c,) for c in [*tx.CODES, "other", None]], "category string")
    got = {r.category: r for r in tx.with_taxonomy(rows).collect()}
    assert [got[c].severity for c in tx.CODES] == [1, 4, 1, 2, 3, 5, 0]
    assert all(r.mitigation and r.owner and len(r.mitigation_steps) >= 3 for r in got.values())
    assert (got["other"].label, got["other"].severity) == ("other", 0)
    assert got["other"].mitigation == got["unknown"].mitigation == got[None].mitigation
    assert rows.where(tx.is_category("category")).count() == 7
    assert rows.where(~tx.is_category(F.col("category"))).count() == 2


def test_the_line_index_finds_what_the_texts_hold(spark):
    """Whole lines, parts of lines, lines over a line end, padded, blank, invented and repeated ones; null and missing texts."""
    r = random.Random(3)
    texts = [(i, "\n".join(r.choice(["alpha beta", " gamma\t", "", "delta", "beta", " é è"]) for _ in range(r.randrange(7)))) for i in range(40)]
    texts += [(40, None), (41, "")]
    choices = ["alpha beta", "beta", "  delta ", "alpha", "gamma", "é", "delta\nbeta", " \t", "", None, "invented", "é è"]
    rows = []
    for n in range(300):
        cited = [r.choice(choices) for _ in range(r.randrange(6))]
        verdict = None if n % 29 == 0 else ("unknown", 0.5, "x", None if n % 31 == 0 else cited, "", False, None, [])
        rows.append((n, r.randrange(43), verdict))  # one excerpt is missing
    excerpts = spark.createDataFrame(texts, "key int, excerpt string")
    verdicts = spark.createDataFrame(rows, f"n int, key int, verdict {VERDICT}")
    got = v.verify_by_index(verdicts, v.line_index(excerpts, "key"), excerpts, "n", "key")
    want = v.verify_citations(verdicts.join(excerpts, "key", "left")).select("n", "key", "verdict")
    assert got.columns == ["n", "key", "verdict"] and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
