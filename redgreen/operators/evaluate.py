"""Scoring a classifier against labels.

Everything derives from ``cells``: counts per (expected, predicted, errored),
one shuffle of at most a few dozen combined rows per map task. What follows it
works on that table, whatever the number of cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redgreen.functions.text import two_places
from redgreen.operators.taxonomy import CATEGORIES, CODES, report_order_of


def outcomes(answered: DataFrame) -> DataFrame:
    """Label against verdict per case, from ``id, expected_category, verdict, classify_error``."""
    v = F.col("verdict")
    error = F.coalesce("classify_error", F.lit(""))
    predicted = F.when(error == "", v["category"])
    return answered.select(
        F.col("id").alias("case_id"),
        F.col("expected_category").alias("expected"),
        predicted.alias("predicted"),
        F.when(error == "", v["confidence"]).otherwise(F.lit(0.0)).alias("confidence"),
        F.coalesce(predicted == F.col("expected_category"), F.lit(False)).alias("correct"),
        F.when(error == "", F.size(v["hallucinated_citations"])).otherwise(F.lit(0)).alias("hallucinated"),
        error.alias("error"),
    )


def cells(outcomes: DataFrame) -> DataFrame:
    """Counts and sums per (expected, predicted, errored)."""
    return outcomes.groupBy("expected", "predicted", (F.col("error") != "").alias("errored")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("correct").alias("n_correct"),
        F.sum(F.when(F.col("correct"), F.col("confidence"))).alias("conf_right"),
        F.sum(F.when(~F.col("correct"), F.col("confidence"))).alias("conf_wrong"),
        F.sum("hallucinated").alias("hallucinated"),
    )


def _ratio(numerator: Column, denominator: Column) -> Column:
    """0 on a zero or missing denominator."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def totals(cells: DataFrame) -> DataFrame:
    """One row: counts, accuracy over scored cases, mean confidences, invented citations."""
    scored = ~F.col("errored")
    sums = cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(scored, F.col("n_correct"))), F.lit(0)).alias("correct"),
        F.coalesce(F.sum(F.when(F.col("errored"), F.col("n"))), F.lit(0)).alias("errored"),
        F.sum(F.when(scored, F.col("conf_right"))).alias("conf_right"),
        F.sum(F.when(scored, F.col("conf_wrong"))).alias("conf_wrong"),
        F.coalesce(F.sum(F.when(scored, F.col("hallucinated"))), F.lit(0)).alias("hallucinated_citations"),
    )
    n_scored = F.col("total") - F.col("errored")
    return sums.select(
        "total",
        "correct",
        "errored",
        _ratio(F.col("correct"), n_scored).alias("accuracy"),
        _ratio(F.col("conf_right"), F.col("correct")).alias("mean_confidence_correct"),
        _ratio(F.col("conf_wrong"), n_scored - F.col("correct")).alias("mean_confidence_wrong"),
        "hallucinated_citations",
    )


def per_category(cells: DataFrame) -> DataFrame:
    """Support, predictions, true positives, precision, recall and F1 by category.

    A category neither labelled nor predicted is absent.
    """
    side = F.explode(
        F.array(
            F.struct(
                F.col("expected").alias("category"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                F.col("n_correct").alias("true_positives"),
            ),
            F.struct(
                F.col("predicted").alias("category"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                F.lit(0).cast("bigint").alias("true_positives"),
            ),
        )
    )
    sides = cells.where(~F.col("errored")).select(side.alias("s")).select("s.*").where(F.col("category").isin(CODES))
    sums = sides.groupBy("category").agg(
        F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"),
        F.sum("true_positives").alias("true_positives"),
    )
    rates = sums.withColumns(
        {
            "precision": _ratio(F.col("true_positives"), F.col("predicted")),
            "recall": _ratio(F.col("true_positives"), F.col("support")),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    return rates.withColumn("f1", _ratio(2 * p * r, p + r))


def macro_f1(per_category: DataFrame) -> DataFrame:
    """Mean F1 over labelled categories, 0 when there are none."""
    labelled = F.avg(F.when(F.col("support") > 0, F.col("f1")))
    return per_category.agg(F.coalesce(labelled, F.lit(0.0)).alias("macro_f1"))


def confusion(cells: DataFrame) -> DataFrame:
    """``(expected, predicted, n)`` of scored cases."""
    return cells.where(~F.col("errored")).select("expected", "predicted", "n")


def confusion_matrix(cells: DataFrame) -> DataFrame:
    """Dense matrix: labelled rows, one column per category in report order.

    The pivot list is given, so no job has to find it.
    """
    matrix = confusion(cells).groupBy("expected").pivot("predicted", CODES).agg(F.sum("n"))
    return matrix.na.fill(0)


def confusion_text(cells: DataFrame) -> DataFrame:
    """``(ord, line)``: the matrix as fixed-width text lines, at most nine."""
    short = {c.code: c.short for c in CATEGORIES}
    heading = "actual \\ predicted  " + "".join(f"{c.short:>6}" for c in CATEGORIES)
    rule = "-" * (20 + 6 * len(CODES))
    name = F.create_map(*[F.lit(x) for pair in short.items() for x in pair])[F.col("expected")]
    numbers = [F.lpad(F.when(F.col(c) == 0, F.lit(".")).otherwise(F.col(c).cast("string")), 6, " ") for c in CODES]
    rows = confusion_matrix(cells).where(F.col("expected").isin(CODES))
    body = rows.select(report_order_of("expected").alias("ord"), F.concat(F.rpad(name, 20, " "), *numbers).alias("line"))
    top = cells.sparkSession.createDataFrame([(-2, heading), (-1, rule)], "ord int, line string")
    return top.unionByName(body)


def scores(outcomes: DataFrame, provider: str, model: str, baseline: bool) -> DataFrame:
    """One nested row with every metric, for the JSON sink.

    Arrays and maps here hold at most 7 and 49 entries, and the cells packed
    into one row about twice that: all parts read that row, so the outcomes are
    computed once.
    """
    table = cells(outcomes)
    table = table.agg(F.collect_list(F.struct(*table.columns)).alias("packed")).select(F.inline("packed"))
    by_category = per_category(table)
    listed = by_category.agg(
        F.sort_array(
            F.collect_list(
                F.struct("category", "support", "predicted", "true_positives", "precision", "recall", "f1")
            )
        ).alias("per_category"),
        F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)).alias("macro_f1"),
    )
    row = confusion(table).groupBy("expected").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("predicted", "n")))).alias("predictions")
    )
    matrix = row.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("expected", F.map_entries("predictions").alias("e"))))).alias("m")
    ).select(F.transform_values("m", lambda _, e: F.map_from_entries(e)).alias("confusion"))
    header = {"provider": F.lit(provider), "model": F.lit(model), "baseline": F.lit(baseline)}
    # One row each: a union and an aggregate instead of a join without a key.
    parts = totals(table).unionByName(listed, allowMissingColumns=True).unionByName(matrix, allowMissingColumns=True)
    return parts.agg(*[F.first(c, ignorenulls=True).alias(c) for c in parts.columns]).withColumns(header)


def case_listing(outcomes: DataFrame) -> DataFrame:
    """Per case PASS, FAIL or ERR with label, prediction and confidence."""
    mark = F.when(F.col("error") != "", F.lit("ERR")).when(F.col("correct"), F.lit("PASS")).otherwise(F.lit("FAIL"))
    return outcomes.select(
        mark.alias("mark"), "case_id", "expected", F.coalesce("predicted", F.lit("")).alias("predicted"),
        two_places("confidence").alias("confidence"), "error",
    )
