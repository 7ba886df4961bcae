"""Model verdicts as tables: prompts out, raw response texts in, one repair round."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redgreen.functions.text import is_blank, let, text_or_empty, utrim
from redgreen.operators.taxonomy import CODES
from redgreen.operators.verdicts import invalid_reason
from redgreen.schemas import VERDICT

# The response shape and the user prompt around one excerpt.
RESPONSE_SHAPE = """{
  "category": "one of: network_timeout | race_condition | infra_flake | resource_exhaustion | test_order_dependency | genuine_bug | unknown",
  "confidence": 0.0,
  "explanation": "one or two sentences, plain English",
  "cited_lines": ["exact lines copied verbatim from the excerpt"],
  "suggested_mitigation": "one concrete action"
}"""
PROMPT_BEFORE_JOB = "Job: "
PROMPT_BEFORE_STEP = "\nFailing step: "
PROMPT_BEFORE_EXCERPT = (
    "\n\nFailure log excerpt (this is the ONLY text you may cite from):\n---BEGIN EXCERPT---\n"
)
PROMPT_END = f"\n---END EXCERPT---\n\nRespond with exactly this JSON shape:\n{RESPONSE_SHAPE}"
NO_JOB = "(unknown job)"
NO_STEP = "(unknown step)"
REPAIR_SUFFIX = """Your previous response could not be parsed.
Respond again with ONE valid JSON object and no other text.
"category" must be exactly one of: network_timeout, race_condition, infra_flake,
resource_exhaustion, test_order_dependency, genuine_bug, unknown."""

# Our own wording of the standing instructions sent with every request.
SYSTEM_PROMPT = f"""You triage flaky CI jobs: a job that failed and passed on one commit.
Read the log excerpt and name its most likely root cause as a single JSON object.
Categories: {", ".join(CODES)}.
Quote evidence only by copying lines of the excerpt unchanged; leave cited_lines
empty when no line supports the verdict. Use unknown with low confidence when the
excerpt does not decide. Confidence is your own probability from 0 to 1."""

_FENCE = "```"
# Standard JSON only: what the default reader adds is switched off.
_JSON_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def prompt(job_name: Column | str, step_name: Column | str, excerpt: Column | str) -> Column:
    def named(c: Column | str, fallback: str) -> Column:
        return F.when(is_blank(c), F.lit(fallback)).otherwise(utrim(c))

    return F.concat(
        F.lit(PROMPT_BEFORE_JOB), named(job_name, NO_JOB),
        F.lit(PROMPT_BEFORE_STEP), named(step_name, NO_STEP),
        F.lit(PROMPT_BEFORE_EXCERPT), text_or_empty(excerpt),
        F.lit(PROMPT_END),
    )


def build_requests(items: DataFrame, on: Sequence[str] = ("id",)) -> DataFrame:
    """``(id, system, prompt)`` for any batch-inference job, from ``id, job_name, step_name, excerpt``.

    ``on`` are the columns that tell requests apart, here and in what follows.
    """
    text = prompt("job_name", "step_name", "excerpt").alias("prompt")
    return items.select(*on, F.lit(SYSTEM_PROMPT).alias("system"), text)


def _unfenced(response: Column) -> Column:
    """Content of the first fenced block, else the whole text."""

    def inside(rest: Column) -> Column:
        after_tag = let(
            F.instr(rest, F.lit("\n")),
            lambda line: F.when(line > 0, F.substring(rest, line + 1, F.length(rest))).otherwise(rest),
        )
        return utrim(F.substring_index(after_tag, _FENCE, 1))

    return let(
        F.instr(response, F.lit(_FENCE)),
        lambda start: F.when(start == 0, response).otherwise(
            let(F.substring(response, start + 3, F.length(response)), inside)
        ),
    )


def _field(entries: Column, name: str) -> Column:
    """The last non-null value under a key, whatever its case."""
    named = F.filter(entries, lambda e: (F.lower(e["key"]) == name) & ~F.is_variant_null(e["value"]))
    return F.try_element_at(named, F.lit(-1))["value"]


def _decoded(fields: Column) -> Column:
    """``struct(verdict, malformed)`` of the five raw fields."""

    def has_type(name: str, *types: str) -> Column:
        return F.coalesce(F.schema_of_variant(fields[name]).rlike(f"^({'|'.join(types)})"), F.lit(True))

    def text(name: str) -> Column:
        return utrim(F.coalesce(F.try_variant_get(fields[name], "$", "string"), F.lit("")))

    typed = (
        has_type("category", "STRING")
        & has_type("confidence", "BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
        & has_type("explanation", "STRING")
        & has_type("cited_lines", "ARRAY<STRING>", "ARRAY<VOID>")
        & has_type("suggested_mitigation", "STRING")
    )
    no_lines = F.array().cast("array<string>")
    lines = F.coalesce(F.try_variant_get(fields["cited_lines"], "$", "array<string>"), no_lines)
    verdict = F.struct(
        F.lower(text("category")).alias("category"),
        F.coalesce(F.try_variant_get(fields["confidence"], "$", "double"), F.lit(0.0)).alias("confidence"),
        text("explanation").alias("explanation"),
        F.transform(lines, lambda x: F.coalesce(x, F.lit(""))).alias("cited_lines"),
        text("suggested_mitigation").alias("suggested_mitigation"),
        F.lit(False).alias("downgraded"),
        F.lit(None).cast("string").alias("raw_category"),
        no_lines.alias("hallucinated_citations"),
    )

    def checked(v: Column) -> Column:
        return let(
            invalid_reason(v),
            lambda reason: F.struct(F.when(reason.isNull(), v).alias("verdict"), reason.alias("malformed")),
        )

    return F.when(~typed, _malformed("wrong field type")).otherwise(let(verdict, checked))


def _malformed(reason: str) -> Column:
    return F.struct(F.lit(None).cast(VERDICT).alias("verdict"), F.lit(reason).alias("malformed"))


def parsed_response(raw: Column | str) -> Column:
    """``struct(verdict, malformed)`` of one raw response; exactly one of them is null.

    The first JSON value at the first brace is decoded and what follows it is
    ignored. Fields are decoded as variants, so each must have its own JSON
    type: a number is no explanation. Keys match in any case, the last one
    wins, and a JSON null leaves a field at its zero value.
    """
    names = ["category", "confidence", "explanation", "cited_lines", "suggested_mitigation"]

    def from_entries(entries: Column) -> Column:
        fields = F.struct(*[_field(entries, n).alias(n) for n in names])
        return F.when(entries.isNull(), _malformed("not a JSON object")).otherwise(let(fields, _decoded))

    def from_text(response: Column) -> Column:
        return let(
            F.instr(response, F.lit("{")),
            lambda brace: F.when(brace == 0, _malformed("no JSON object found")).otherwise(
                let(
                    F.map_entries(
                        F.from_json(
                            F.substring(response, brace, F.length(response)), "map<string,variant>", _JSON_OPTIONS
                        )
                    ),
                    from_entries,
                )
            ),
        )

    return let(
        utrim(text_or_empty(raw)),
        lambda trimmed: F.when(trimmed == "", _malformed("empty response")).otherwise(
            let(_unfenced(trimmed), from_text)
        ),
    )


def parse_responses(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``verdict`` and ``malformed`` (the reason, null for a usable response)."""
    parsed = responses.withColumn("parsed", parsed_response(raw))
    return parsed.select(*responses.columns, "parsed.verdict", "parsed.malformed")


def repair_requests(requests: DataFrame, first_round: DataFrame, on: Sequence[str] = ("id",)) -> DataFrame:
    """Second prompts for malformed responses only; a transport error gets none."""
    again = first_round.where(F.col("malformed").isNotNull() & F.col("transport_error").isNull()).select(*on)
    wanted = requests.join(again, [*on], "left_semi")
    return wanted.select(*on, "system", F.concat("prompt", F.lit("\n\n" + REPAIR_SUFFIX)).alias("prompt"))


def merge_rounds(
    first_round: DataFrame, second_round: DataFrame, provider: str = "model", on: Sequence[str] = ("id",)
) -> DataFrame:
    """``(id, verdict, error)`` after at most one repair.

    Both inputs are parsed responses ``(id, verdict, malformed, transport_error)``.
    """
    second = second_round.select(
        *on,
        F.col("verdict").alias("verdict2"),
        F.coalesce("transport_error", "malformed").alias("problem2"),
    )
    both = first_round.join(second, [*on], "left")
    repairable = F.col("transport_error").isNull() & F.col("malformed").isNotNull()
    twice = F.concat(
        F.lit(f"{provider} returned unparseable output twice: "), F.coalesce("problem2", F.lit("no second response"))
    )
    return both.select(
        *on,
        F.when(F.col("transport_error").isNull(), F.coalesce("verdict", F.when(repairable, F.col("verdict2")))).alias(
            "verdict"
        ),
        F.when(F.col("transport_error").isNotNull(), F.col("transport_error"))
        .when(repairable & F.col("verdict2").isNull(), twice)
        .alias("error"),
    )


def with_answers(requests: DataFrame, answers: DataFrame, on: Sequence[str] = ("id",)) -> DataFrame:
    """Requests plus ``verdict`` and ``classify_error``; one without any response is an error."""
    answered = answers.select(*on, "verdict", F.col("error").alias("classify_error"), F.lit(True).alias("answered"))
    joined = requests.join(answered, [*on], "left")
    missing = F.when(F.col("answered").isNull(), F.lit("no response"))
    return joined.withColumn("classify_error", F.coalesce("classify_error", missing)).drop("answered")
