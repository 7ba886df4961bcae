"""Choosing the failing step of an archive and cutting its log to an excerpt."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redgreen.functions.logs import (
    DROPPED_HEAD,
    ELISION,
    collapse_blank_lines,
    error_block,
    failure_score,
    head_lines,
)
from redgreen.functions.text import let, text_or_empty
from redgreen.sources.archives import step_position


@dataclass(frozen=True)
class ExcerptOptions:
    """Budget in characters, and the lines kept around the anchor and at the top."""

    # Defaults.
    max_chars: int = 12000
    lines_before: int = 60
    lines_after: int = 25
    head_lines: int = 12

    def effective(self) -> ExcerptOptions:
        """No budget means all defaults."""
        return self if self.max_chars > 0 else ExcerptOptions()


def anchor_window(steps: DataFrame, options: ExcerptOptions = ExcerptOptions()) -> DataFrame:
    """Add ``anchor`` (0-based line of the collapsed body, or null) and ``block``."""
    o = options.effective()
    found = let(collapse_blank_lines(text_or_empty("body")), lambda b: error_block(b, o.lines_before, o.lines_after))
    return steps.withColumn("found", found).select(*steps.columns, "found.anchor", "found.block")


def excerpt_of(step_name: Column | str, body: Column | str, options: ExcerptOptions = ExcerptOptions()) -> Column:
    """``struct<text, step_name, original_bytes, excerpt_bytes, truncated>`` of one step log.

    Head lines and the window meet at an elision marker unless the window
    already holds the head. Over budget, the last ``max_chars`` characters stay.
    """
    o = options.effective()
    step = F.col(step_name) if isinstance(step_name, str) else step_name

    def joined(collapsed: Column) -> Column:
        def with_head(block: Column) -> Column:
            return let(
                head_lines(collapsed, o.head_lines),
                lambda head: F.when(
                    (head != "") & ~F.contains(block, head), F.concat(head, F.lit(ELISION), block)
                ).otherwise(block),
            )

        return let(error_block(collapsed, o.lines_before, o.lines_after)["block"], with_head)

    def fitted(raw: Column, collapsed: Column, text: Column) -> Column:
        over = F.octet_length(text) > o.max_chars
        kept = F.when(
            over & (F.length(text) > o.max_chars), F.concat(F.lit(DROPPED_HEAD), F.right(text, F.lit(o.max_chars)))
        ).otherwise(text)
        return let(
            kept,
            lambda t: F.struct(
                t.alias("text"),
                step.alias("step_name"),
                F.octet_length(raw).alias("original_bytes"),
                F.octet_length(t).alias("excerpt_bytes"),
                (over | (F.octet_length(text) < F.octet_length(collapsed))).alias("truncated"),
            ),
        )

    return let(
        text_or_empty(body),
        lambda raw: let(
            collapse_blank_lines(raw),
            lambda collapsed: let(joined(collapsed), lambda text: fitted(raw, collapsed, text)),
        ),
    )


def add_excerpt(steps: DataFrame, options: ExcerptOptions = ExcerptOptions()) -> DataFrame:
    """Add ``excerpt``; narrow, each text pass made once."""
    return steps.withColumn("excerpt", excerpt_of("step_name", "body", options))


def failing_step(steps: DataFrame) -> DataFrame:
    """Per readable archive the step with the highest score, the later one on ties.

    With no scoring step at all every score is 0 and the last step wins, which
    is the fallback wanted. Bodies are scored where they are read; scores and
    places are ranked, of which each task passes on one per archive.
    """
    scored = steps.where(F.col("error").isNull()) if "error" in steps.columns else steps
    scored = scored.select("archive", "job_dir", "step_order", "step_name", "entry_no", failure_score("step_name", "body").alias("score"))
    best = Window.partitionBy("archive").orderBy(F.desc("score"), F.desc("job_dir"), F.desc("step_order"), F.desc("entry_no"))
    chosen = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") == 1)
    return chosen.select("archive", "job_dir", "step_order", "step_name", "score")


def chosen_excerpts(archives: DataFrame, options: ExcerptOptions = ExcerptOptions()) -> DataFrame:
    """``(archive, excerpt, error)`` of ``archives_with_steps``: every step is scored, the best one cut.

    All steps of an archive are in its row, so nothing is shuffled, sorted or
    aggregated, and no other step's excerpt is ever made.
    """

    def best(steps: Column) -> Column:
        def rank(s: Column, i: Column) -> Column:
            score = failure_score(s["step_name"], s["body"]).alias("score")
            return F.struct(score, *[s[c].alias(c) for c in ("job_dir", "step_order", "entry_no")], i.alias("at"))

        return let(F.array_max(F.transform(steps, rank)), lambda r: F.get(steps, r["at"]))

    found = F.when(F.col("error").isNull() & (F.size("steps") > 0), best(F.col("steps")))
    excerpt = let(found, lambda s: F.when(s.isNotNull(), excerpt_of(s["step_name"], s["body"], options)))
    return archives.select("archive", excerpt.alias("excerpt"), "error")


def archive_excerpts(steps: DataFrame, options: ExcerptOptions = ExcerptOptions()) -> DataFrame:
    """``(archive, excerpt, error)``: one excerpt per archive in a single pass.

    Excerpts are cut before the shuffle, so what moves per step is bounded by
    the budget however long its log is, and map-side combining leaves one row
    per archive and task. An archive that could not be read keeps its error.
    """
    usable = F.col("error").isNull()
    cut = steps.select(
        "archive",
        "error",
        F.when(usable, F.struct(failure_score("step_name", "body").alias("score"), step_position())).alias("rank"),
        F.when(usable, excerpt_of("step_name", "body", options)).alias("excerpt"),
    )
    return cut.groupBy("archive").agg(F.max_by("excerpt", "rank").alias("excerpt"), F.max("error").alias("error"))
