import json

import pytest

from redgreen.operators import responses as rs
from redgreen.plans.workflow import classifier


def obj(**changes):
    fields = {
        "category": "network_timeout", "confidence": 0.9, "explanation": "dial timeout", "cited_lines": ["dial"],
        "suggested_mitigation": " retry ",
    }
    return json.dumps({**fields, **changes})


def parse(spark, *raws):
    rows = spark.createDataFrame(list(enumerate(raws)), "id int, raw string")
    return rs.parse_responses(rows).orderBy("id").collect()


GOOD = {
    "bare": (obj(), "network_timeout", 0.9),
    "fenced": ("Here:\n```json\n" + obj(category="race_condition", confidence=0.75) + "\n```\nDone.", "race_condition", 0.75),
    "unclosed fence": ("```\n" + obj(), "network_timeout", 0.9),
    "one-line fence": ("```" + obj() + "```", "network_timeout", 0.9),
    "in prose": ("Sure! " + obj(category="infra_flake", confidence=0.6) + " Let me know }.", "infra_flake", 0.6),
    "braces in strings": (obj(explanation="map {a:1} \"differed\"", cited_lines=["got {x:2}"]), "network_timeout", 0.9),
    "case and space": (obj(category="  NETWORK_Timeout "), "network_timeout", 0.9),
    "integer confidence": (obj(confidence=1), "network_timeout", 1.0),
    "no confidence": ('{"category":"unknown","explanation":"x"}', "unknown", 0.0),
    "null fields": (obj(confidence=None, cited_lines=None, suggested_mitigation=None), "network_timeout", 0.0),
    "keys in any case": ('{"Category":"unknown","CONFIDENCE":0.3,"explanation":"x"}', "unknown", 0.3),
    "last key wins": ('{"category":"unknown","Category":"infra_flake","explanation":"x","confidence":0.2}', "infra_flake", 0.2),
    "later null is ignored": ('{"category":"unknown","category":null,"explanation":"x","confidence":0.2}', "unknown", 0.2),
    "extra keys": (obj(mood={"a": [1]}), "network_timeout", 0.9),
    "second object": (obj() + obj(category="unknown"), "network_timeout", 0.9),
}
BAD = {
    "empty": ("", "empty response"),
    "blank": ("  \n", "empty response"),
    "missing": (None, "empty response"),
    "no object": ("I could not determine the cause.", "no JSON object found"),
    "empty fence": ("```json\n```\n" + obj(), "no JSON object found"),
    "bad category": (obj(category="cosmic_rays"), "unknown category cosmic_rays"),
    "no category": ('{"confidence":0.9,"explanation":"x"}', "unknown category "),
    "confidence out of range": (obj(confidence=7), "confidence 7.000 outside [0,1]"),
    "blank explanation": (obj(explanation="\t"), "empty explanation"),
    "unbalanced": (obj()[:-1], "not a JSON object"),
    "single quotes": ("{'category':'unknown','explanation':'x'}", "not a JSON object"),
    "trailing comma": ('{"category":"unknown","explanation":"x",}', "not a JSON object"),
    "brace in prose first": ("Use {x}: " + obj(), "not a JSON object"),
    "raw line feed in string": ('{"category":"unknown","explanation":"a\nb"}', "not a JSON object"),
    "bare NaN": ('{"category":"unknown","explanation":"x","confidence":NaN}', "not a JSON object"),
    "number as category": (obj(category=7), "wrong field type"),
    "text as confidence": (obj(confidence="0.9"), "wrong field type"),
    "number as explanation": (obj(explanation=7), "wrong field type"),
    "text as lines": (obj(cited_lines="dial"), "wrong field type"),
    "numbers as lines": (obj(cited_lines=["a", 1]), "wrong field type"),
}


def test_usable_responses(spark):
    for (name, (_, category, confidence)), row in zip(GOOD.items(), parse(spark, *[g[0] for g in GOOD.values()])):
        assert row.malformed is None, name
        assert (row.verdict.category, row.verdict.confidence) == (category, confidence), name
    first = parse(spark, obj(cited_lines=["a", None, " b "]))[0].verdict
    assert (first.cited_lines, first.suggested_mitigation, first.downgraded) == (["a", "", " b "], "retry", False)


def test_malformed_responses(spark):
    for (name, (_, reason)), row in zip(BAD.items(), parse(spark, *[b[0] for b in BAD.values()])):
        assert (row.verdict, row.malformed) == (None, reason), name


def test_prompt(spark):
    rows = spark.createDataFrame([(1, " unit ", None, "log text"), (2, "", "Run", "")], "id int, job_name string, step_name string, excerpt string")
    one, two = [r.prompt for r in rs.build_requests(rows).orderBy("id").collect()]
    assert one.startswith("Job: unit\nFailing step: (unknown step)\n\n")
    assert "---BEGIN EXCERPT---\nlog text\n---END EXCERPT---" in one and one.endswith(rs.RESPONSE_SHAPE)
    assert two.startswith("Job: (unknown job)\nFailing step: Run\n")


ROUND = "id int, raw string, transport_error string"


def test_one_repair_for_malformed_only(spark):
    requests = spark.createDataFrame(
        [(i, "unit", "Run", "log") for i in range(6)], "id int, job_name string, step_name string, excerpt string"
    )
    first = spark.createDataFrame(
        [(0, obj(), None), (1, "nonsense", None), (2, "nonsense", None), (3, None, "connection refused"), (4, "bad", None)],
        ROUND,
    )
    parsed = rs.parse_responses(first)
    asked = rs.repair_requests(rs.build_requests(requests), parsed).orderBy("id").collect()
    assert [r.id for r in asked] == [1, 2, 4]
    assert all(r.prompt.endswith("\n\n" + rs.REPAIR_SUFFIX) for r in asked)
    second = spark.createDataFrame(
        [(0, obj(category="unknown"), None), (1, obj(category="infra_flake"), None), (2, "still bad", None),
         (3, obj(), None), (4, None, "timed out")],
        ROUND,
    )
    model = classifier("responses", first=first, second=second, provider="acme", model="m1")
    got = {r.id: r for r in model.run(requests).collect()}
    assert got[0].verdict.category == "network_timeout" and got[0].classify_error is None
    assert got[1].verdict.category == "infra_flake" and got[1].classify_error is None
    assert got[2].classify_error == "acme returned unparseable output twice: no JSON object found"
    assert (got[3].verdict, got[3].classify_error) == (None, "connection refused")
    assert got[4].classify_error == "acme returned unparseable output twice: timed out"
    assert (got[5].verdict, got[5].classify_error) == (None, "no response")
    assert (model.name, model.model, model.baseline) == ("acme", "m1", False)


def test_unknown_classifier():
    with pytest.raises(ValueError, match="unknown classifier"):
        classifier("oracle")
    assert classifier("deterministic").baseline
