import pytest

from redgreen.operators import evaluate as ev
from redgreen.operators.taxonomy import CODES

SCHEMA = "case_id string, expected string, predicted string, confidence double, correct boolean, hallucinated int, error string"


def outcomes(spark, *rows):
    full = [
        (str(i), e, p, c, p == e, h, err) for i, (e, p, c, h, err) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA)


MIXED = [
    ("network_timeout", "network_timeout", 0.9, 0, ""),
    ("network_timeout", "infra_flake", 0.4, 2, ""),
    ("infra_flake", "infra_flake", 0.7, 0, ""),
    ("unknown", "race_condition", 0.6, 1, ""),
    ("genuine_bug", None, 0.0, 0, "timed out"),
]


def test_perfect(spark):
    cells = ev.cells(outcomes(spark, *[(c, c, 0.8, 0, "") for c in CODES]))
    row = ev.totals(cells).first()
    assert (row.total, row.correct, row.accuracy, row.mean_confidence_wrong) == (7, 7, 1.0, 0.0)
    assert ev.macro_f1(ev.per_category(cells)).first().macro_f1 == 1.0


def test_mixed(spark):
    cells = ev.cells(outcomes(spark, *MIXED))
    row = ev.totals(cells).first()
    assert (row.total, row.correct, row.errored, row.accuracy, row.hallucinated_citations) == (5, 2, 1, 0.5, 3)
    assert row.mean_confidence_correct == pytest.approx(0.8) and row.mean_confidence_wrong == pytest.approx(0.5)
    table = {r.category: r for r in ev.per_category(cells).collect()}
    assert set(table) == {"network_timeout", "infra_flake", "unknown", "race_condition"}
    net, infra, race = table["network_timeout"], table["infra_flake"], table["race_condition"]
    assert (net.support, net.predicted, net.true_positives, net.precision, net.recall) == (2, 1, 1, 1.0, 0.5)
    assert infra.f1 == pytest.approx(2 / 3) and net.f1 == pytest.approx(2 / 3)
    assert (race.support, race.predicted, race.precision, race.recall, race.f1) == (0, 1, 0.0, 0.0, 0.0)
    # Macro-F1 averages the three labelled categories only.
    assert ev.macro_f1(ev.per_category(cells)).first().macro_f1 == pytest.approx((2 / 3 + 2 / 3 + 0) / 3)


def test_only_errors_and_nothing(spark):
    for rows in ([("unknown", None, 0.0, 0, "x")], []):
        cells = ev.cells(outcomes(spark, *rows))
        row = ev.totals(cells).first()
        assert (row.total, row.errored, row.correct, row.accuracy) == (len(rows), len(rows), 0, 0.0)
        assert ev.per_category(cells).count() == 0
        assert ev.macro_f1(ev.per_category(cells)).first().macro_f1 == 0.0


def test_matrix(spark):
    cells = ev.cells(outcomes(spark, *MIXED))
    matrix = {r.expected: r.asDict() for r in ev.confusion_matrix(cells).collect()}
    assert set(matrix) == {"network_timeout", "infra_flake", "unknown"}
    assert list(matrix["unknown"]) == ["expected", *CODES]
    assert matrix["network_timeout"]["infra_flake"] == 1 and matrix["network_timeout"]["genuine_bug"] == 0
    lines = [r.line for r in ev.confusion_text(cells).orderBy("ord").collect()]
    assert lines[0] == "actual \\ predicted     net  race infra   res order   bug   unk"
    assert lines[1] == "-" * 62
    assert lines[2] == "net                      1     .     1     .     .     .     ."
    assert [x.split()[0] for x in lines[2:]] == ["net", "infra", "unk"]


def test_nested_scores(spark):
    row = ev.scores(outcomes(spark, *MIXED), "deterministic", "rule-based-v1", True).first()
    assert (row.provider, row.baseline, row.total, row.errored) == ("deterministic", True, 5, 1)
    assert [c.category for c in row.per_category] == ["infra_flake", "network_timeout", "race_condition", "unknown"]
    assert row.confusion == {
        "network_timeout": {"infra_flake": 1, "network_timeout": 1}, "infra_flake": {"infra_flake": 1},
        "unknown": {"race_condition": 1},
    }


def test_listing(spark):
    rows = ev.case_listing(outcomes(spark, *MIXED)).orderBy("case_id").collect()
    assert [r.mark for r in rows] == ["PASS", "FAIL", "PASS", "FAIL", "ERR"]
    assert (rows[0].confidence, rows[4].predicted, rows[4].error) == ("0.90", "", "timed out")
