"""Checks every verdict passes: validity, citation evidence, confidence floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redgreen.functions.text import col, is_blank, let, text_or_empty, utrim
from redgreen.operators.taxonomy import UNKNOWN, is_category

# Fixed value: verdicts below this confidence become unknown.
DEFAULT_FLOOR = 0.5


def invalid_reason(verdict: Column | str = "verdict") -> Column:
    """Why a verdict breaks the schema, null when it does not; checked in this order."""
    v = col(verdict)
    confidence = F.coalesce(v["confidence"], F.lit(0.0))
    return (
        F.when(~is_category(v["category"]), F.concat(F.lit("unknown category "), F.coalesce(v["category"], F.lit(""))))
        .when(
            (confidence < 0) | (confidence > 1),
            F.format_string("confidence %.3f outside [0,1]", confidence),
        )
        .when(is_blank(v["explanation"]), F.lit("empty explanation"))
    )


def with_validity(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    return df.withColumn("invalid_reason", invalid_reason(verdict)).withColumn(
        "valid", F.col("invalid_reason").isNull()
    )


def _rebuilt(v: Column, **changed: Column) -> Column:
    fields = [
        "category", "confidence", "explanation", "cited_lines", "suggested_mitigation", "downgraded",
        "raw_category", "hallucinated_citations",
    ]
    return F.when(v.isNotNull(), F.struct(*[changed.get(f, v[f]).alias(f) for f in fields]))


def verified(verdict: Column, excerpt: Column) -> Column:
    """The verdict with only the cited lines that occur in the excerpt.

    The rest moves to ``hallucinated_citations``. Lines compare trimmed but are
    kept as written; blank ones are dropped.
    """

    def sorted_out(v: Column, text: Column) -> Column:
        cited = F.coalesce(v["cited_lines"], F.array().cast("array<string>"))
        lines = F.filter(cited, lambda x: ~is_blank(x))
        return _rebuilt(
            v,
            cited_lines=F.filter(lines, lambda x: F.contains(text, utrim(x))),
            hallucinated_citations=F.filter(lines, lambda x: ~F.contains(text, utrim(x))),
        )

    return let(verdict, lambda v: let(text_or_empty(excerpt), lambda text: sorted_out(v, text)))


def floored(verdict: Column, floor: float = DEFAULT_FLOOR) -> Column:
    """Demote a verdict under the floor to unknown, keeping its raw category; at the floor it stays."""
    if not 0 <= floor <= 1:
        raise ValueError(f"floor must be in [0,1], got {floor:.2f}")

    def judged(v: Column) -> Column:
        demoted = _rebuilt(
            v, category=F.lit(UNKNOWN), downgraded=F.lit(True), raw_category=v["category"]
        )
        return F.when((v["category"] != UNKNOWN) & (v["confidence"] < floor), demoted).otherwise(v)

    return let(verdict, judged)


def verify_citations(df: DataFrame, excerpt: str = "excerpt", verdict: str = "verdict") -> DataFrame:
    return df.withColumn(verdict, verified(F.col(verdict), F.col(excerpt)))


def _trimmed_hash(line: Column) -> Column:
    return F.md5(F.encode(utrim(line), "UTF-8"))


def line_index(excerpts: DataFrame, key: str, excerpt: str = "excerpt") -> DataFrame:
    """``(key, line)``: the hash of every line of every excerpt, trimmed, once each; blank lines left out.

    Land it beside the excerpts: any number of verdicts is then checked without
    moving a text.
    """
    lines = F.filter(F.split(text_or_empty(excerpt), "\n"), lambda x: ~is_blank(x))
    return excerpts.select(key, F.explode(F.array_distinct(F.transform(lines, _trimmed_hash))).alias("line")).distinct()


def verify_by_index(
    verdicts: DataFrame, index: DataFrame, excerpts: DataFrame, row: str, key: str, excerpt: str = "excerpt", verdict: str = "verdict"
) -> DataFrame:
    """``verify_citations`` of verdicts kept apart from their excerpts.

    ``row`` names a verdict, ``key`` its excerpt; ``index`` is ``line_index`` of
    ``excerpts``. A citation that is a whole line is found by its hash. Only
    those that are not, parts of lines or invented ones, are looked up in the
    text, and only their excerpts move.
    """
    cited = verdicts.select(row, key, F.posexplode(f"{verdict}.cited_lines").alias("place", "cited")).where(~is_blank("cited"))
    known = index.select(key, F.col("line").alias("_line"), F.lit(True).alias("_whole"))
    met = cited.withColumn("_line", _trimmed_hash(F.col("cited"))).join(known, [key, "_line"], "left")
    whole = met.where(F.col("_whole")).select(row, "place", "cited", F.lit(True).alias("found"))
    texts = excerpts.select(key, text_or_empty(excerpt).alias("_text"))
    part = met.where(F.col("_whole").isNull()).join(texts, key, "left")
    part = part.select(row, "place", "cited", F.coalesce(F.contains("_text", utrim("cited")), F.lit(False)).alias("found"))
    # A row's citations, a few lines each, back in their order.
    sorted_ = F.sort_array(F.collect_list(F.struct("place", "cited", "found")))
    lines = whole.union(part).groupBy(row).agg(sorted_.alias("_cited"))
    both = verdicts.join(lines, row, "left")

    def of(found: bool) -> Column:
        some = F.filter("_cited", lambda x: x["found"] == F.lit(found))
        return F.transform(some, lambda x: x["cited"])

    v = F.col(verdict)
    empty = F.array().cast("array<string>")
    kept = {name: F.when(F.col("_cited").isNull(), empty).otherwise(of(ok)) for name, ok in (("cited_lines", True), ("hallucinated_citations", False))}
    return both.withColumn(verdict, _rebuilt(v, **kept)).select(*verdicts.columns)


def apply_floor(df: DataFrame, floor: float = DEFAULT_FLOOR, verdict: str = "verdict") -> DataFrame:
    return df.withColumn(verdict, floored(F.col(verdict), floor))


def settle(df: DataFrame, floor: float = DEFAULT_FLOOR, excerpt: str = "excerpt", verdict: str = "verdict") -> DataFrame:
    """Post-processing in its fixed order: citations first, then the floor."""
    return df.withColumn(verdict, floored(verified(F.col(verdict), F.col(excerpt)), floor))
