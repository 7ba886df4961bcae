"""The rule classifier: weighted pattern matches to a verdict per excerpt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redgreen.functions.rules import RULES, Rule, matching_rules
from redgreen.functions.text import constant, let, text_or_empty
from redgreen.operators.taxonomy import UNKNOWN, label_of, mitigation_of

# Confidence formula, citation limit and wording.
BASELINE_NOTE = "rule-based baseline (no language model involved)"
NO_MATCH_TEXT = f"No known failure pattern matched this excerpt. {BASELINE_NOTE}."
NO_MATCH_CONFIDENCE = 0.2
BASE_CONFIDENCE = 0.45
PER_POINT = 0.10
PER_MARGIN = 0.08
MAX_CONFIDENCE = 0.92
MAX_CITATIONS = 3


def rule_hits(df: DataFrame, key: str, excerpt: str = "excerpt", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(key, rule, category, weight, line)``: one row per matching rule.

    A constant rule table inside the projection: no join, no shuffle.
    """
    found = let(text_or_empty(excerpt), lambda text: matching_rules(text, rules))
    return df.select(key, F.inline(found))


def ranking(matched: Column, rules: Sequence[Rule] = RULES) -> Column:
    """``struct(best struct<score, tie, category, matched>, runner_up)`` of the matching rules.

    Categories rank by score, then by name; one without a match has score 0.
    Weights are halves, so sums are exact in any order.
    """
    names = sorted({r.category for r in rules})
    rows = [{"name": c, "tie": -i} for i, c in enumerate(names)]
    categories = constant(rows, "array<struct<name string, tie int>>")

    def scored(c: Column) -> Column:
        own = F.filter(matched, lambda m: m["category"] == c["name"])
        return let(
            own,
            lambda hits: F.struct(
                F.aggregate(hits, F.lit(0.0), lambda total, m: total + m["weight"]).alias("score"),
                c["tie"].alias("tie"),
                c["name"].alias("category"),
                F.size(hits).alias("matched"),
            ),
        )

    ranked = F.sort_array(F.transform(categories, scored), asc=False)
    return let(
        ranked,
        lambda r: F.struct(
            r[0].alias("best"), F.coalesce(F.try_element_at(r, F.lit(2))["score"], F.lit(0.0)).alias("runner_up")
        ),
    )


def rule_scores(df: DataFrame, key: str, excerpt: str = "excerpt", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(key, category, score, runner_up)`` of the rows that some rule matches."""
    found = let(text_or_empty(excerpt), lambda text: matching_rules(text, rules))
    place = let(found, lambda m: F.when(F.size(m) > 0, ranking(m, rules)))
    ranked = df.select(key, place.alias("place")).where(F.col("place").isNotNull())
    return ranked.select(key, "place.best.category", "place.best.score", "place.runner_up")


def citations(matched: Column, category: Column) -> Column:
    """Lines the winning category's rules matched: rule order, no repeats, first three."""
    winning = F.filter(matched, lambda m: m["category"] == category)
    return F.slice(F.array_distinct(F.transform(winning, lambda m: m["line"])), 1, MAX_CITATIONS)


def _verdict(category: Column, confidence: Column, explanation: Column, cited: Column) -> Column:
    return F.struct(
        category.alias("category"),
        confidence.alias("confidence"),
        explanation.alias("explanation"),
        cited.alias("cited_lines"),
        mitigation_of(category).alias("suggested_mitigation"),
        F.lit(False).alias("downgraded"),
        F.lit(None).cast("string").alias("raw_category"),
        F.array().cast("array<string>").alias("hallucinated_citations"),
    )


def verdict_of(matched: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The verdict of the rules that matched a text, as one bound expression."""
    no_match = _verdict(
        F.lit(UNKNOWN), F.lit(NO_MATCH_CONFIDENCE), F.lit(NO_MATCH_TEXT), F.array().cast("array<string>")
    )

    def decided(matched: Column, place: Column) -> Column:
        best = place["best"]
        margin = best["score"] - place["runner_up"]
        confidence = F.lit(BASE_CONFIDENCE) + F.lit(PER_POINT) * best["score"] + F.lit(PER_MARGIN) * margin
        patterns = F.when(best["matched"] == 1, F.lit("1 pattern")).otherwise(
            F.concat(best["matched"].cast("string"), F.lit(" patterns"))
        )
        explanation = F.concat(
            F.lit("Matched "), patterns, F.lit(" for "), label_of(best["category"]), F.lit(f". {BASELINE_NOTE}.")
        )
        return _verdict(
            best["category"],
            F.least(F.lit(MAX_CONFIDENCE), confidence),
            explanation,
            citations(matched, best["category"]),
        )

    return let(
        matched,
        lambda matched: F.when(F.size(matched) == 0, no_match).otherwise(
            let(ranking(matched, rules), lambda place: decided(matched, place))
        ),
    )


def rule_verdict(excerpt: Column | str, rules: Sequence[Rule] = RULES) -> Column:
    """The verdict of one text as a single bound expression."""
    return let(text_or_empty(excerpt), lambda text: verdict_of(matching_rules(text, rules), rules))


def classify_by_rules(df: DataFrame, excerpt: str = "excerpt", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``verdict`` to every row; narrow, no shuffle."""
    return df.withColumn("verdict", rule_verdict(excerpt, rules))
