"""The weighted rule table and its translation to Spark expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from redgreen.functions.text import constant, fold_for_search, let, utrim


class Rule(NamedTuple):
    category: str
    weight: float
    pattern: str


# The 38 default rules, in order.
RULES = [
    Rule("network_timeout", 3.0, r"(?i)\bi/o timeout\b"),
    Rule("network_timeout", 3.0, r"(?i)\bdial tcp\b"),
    Rule("network_timeout", 2.5, r"(?i)connection (refused|reset by peer)"),
    Rule("network_timeout", 2.5, r"(?i)tls handshake timeout"),
    Rule("network_timeout", 2.0, r"(?i)context deadline exceeded"),
    Rule("network_timeout", 2.0, r"(?i)(no such host|temporary failure in name resolution)"),
    Rule("network_timeout", 1.5, r"(?i)could not resolve host"),
    Rule("race_condition", 4.0, r"(?i)WARNING: DATA RACE"),
    Rule("race_condition", 3.0, r"(?i)send on closed channel"),
    Rule("race_condition", 3.0, r"(?i)concurrent map (read and map )?write"),
    Rule("race_condition", 2.5, r"(?i)all goroutines are asleep - deadlock"),
    Rule("race_condition", 2.0, r"(?i)race detector"),
    Rule("race_condition", 1.5, r"(?i)(previous write|previous read) at 0x"),
    Rule("infra_flake", 3.5, r"(?i)runner has received a shutdown signal"),
    Rule("infra_flake", 3.5, r"(?i)lost communication with the server"),
    Rule("infra_flake", 3.0, r"(?i)the runner has received a shutdown"),
    Rule("infra_flake", 2.5, r"(?i)failed to download action"),
    Rule("infra_flake", 2.5, r"(?i)the operation was canceled.*runner"),
    Rule("infra_flake", 2.0, r"(?i)docker daemon.*not running"),
    Rule("infra_flake", 2.0, r"(?i)spot instance.*(reclaim|interrupt)"),
    Rule("resource_exhaustion", 4.0, r"(?i)no space left on device"),
    Rule("resource_exhaustion", 4.0, r"(?i)\boom-?killed\b"),
    Rule("resource_exhaustion", 3.5, r"(?i)out of memory"),
    Rule("resource_exhaustion", 3.0, r"(?i)cannot allocate memory"),
    Rule("resource_exhaustion", 3.0, r"(?i)too many open files"),
    Rule("resource_exhaustion", 2.5, r"(?i)signal: killed"),
    Rule("resource_exhaustion", 2.0, r"(?i)exit code 137"),
    Rule("test_order_dependency", 3.5, r"(?i)-shuffle"),
    Rule("test_order_dependency", 3.0, r"(?i)passes in isolation"),
    Rule("test_order_dependency", 3.0, r"(?i)shared fixture"),
    Rule("test_order_dependency", 2.5, r"(?i)leaked state"),
    Rule("test_order_dependency", 2.5, r"(?i)(already exists|duplicate).*(registry|registered)"),
    Rule("test_order_dependency", 2.0, r"(?i)test order"),
    Rule("genuine_bug", 3.0, r"(?i)nil pointer dereference"),
    Rule("genuine_bug", 3.0, r"(?i)index out of range"),
    Rule("genuine_bug", 2.5, r"(?i)expected .* (got|but got) "),
    Rule("genuine_bug", 2.0, r"(?i)assertion failed"),
    Rule("genuine_bug", 2.0, r"(?i)invalid memory address"),
]

_WORD = "[0-9A-Za-z_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def java_regex(pattern: str) -> str:
    r"""A rule pattern with the meaning its table intends, for Java's engine.

    Rules assume an ASCII word edge, ``.`` that stops at line feeds only, and
    case folding in which the Kelvin sign and the long s equal ``k`` and ``s``.
    """
    body = pattern.removeprefix("(?i)")
    out = re.sub(r"\\b", lambda _: _EDGE, body)
    if body != pattern:
        out = re.sub(r"\\.|\[[^\]]*\]|[kK]|[sS]", _fold_letter, out)
        return "(?id)" + out
    return "(?d)" + out


def _fold_letter(m: re.Match[str]) -> str:
    return {"k": r"[k\u212A]", "s": r"[s\u017F]"}.get(m.group().lower(), m.group())


def required_literals(pattern: str) -> list[list[str]]:
    """Lower-case texts a match must contain: one of each inner list.

    Only plain patterns qualify: anything but literal text, word edges, ``.*``,
    groups of plain alternatives and ``x?`` gives none, and the regular
    expression decides alone.
    """
    if not pattern.startswith("(?i)"):
        return []
    body = pattern.removeprefix("(?i)").replace(r"\b", "")
    parts = re.split(r"(\([^()]*\)\??)|\.\*|.\?", body)
    needed = []
    for part in filter(None, parts):
        if part.endswith(")?"):
            continue
        choices = part.strip("()").split("|") if part.startswith("(") else [part]
        if not all(re.fullmatch(r"[A-Za-z0-9 /:_-]+", c) for c in choices):
            return []
        if all(len(c.strip()) > 1 for c in choices):
            needed.append([c.lower() for c in choices])
    return needed


def line_regex(pattern: str) -> str:
    """The whole line around a match; no default rule can match a line feed."""
    flags, _, body = java_regex(pattern).partition(")")
    return f"{flags}m)^[^\\n]*?(?:{body})[^\\n]*"


_RULE_ARRAY = (
    "array<struct<rule int, category string, weight double, needs array<array<string>>, first array<string>, "
    "regex string, line_regex string>>"
)


def rule_array(rules: Sequence[Rule]) -> Column:
    """The rule table as one constant, folded into the plan as a literal.

    ``first`` is the most telling group of ``needs``: no line without one of
    its texts can match.
    """
    rows = []
    for i, r in enumerate(rules):
        needs = required_literals(r.pattern)
        rows.append(
            {
                "rule": i,
                "category": r.category,
                "weight": r.weight,
                "needs": needs,
                "first": max(needs, key=lambda choices: min(map(len, choices)), default=[]),
                "regex": java_regex(r.pattern),
                "line_regex": line_regex(r.pattern),
            }
        )
    return constant(rows, _RULE_ARRAY)


def line_at(text: Column, position: Column) -> Column:
    """The line around a 1-based character position."""
    start = F.substring_index(F.left(text, position - 1), "\n", -1)
    rest = F.substring_index(F.substring(text, position, F.length(text)), "\n", 1)
    return F.concat(start, rest)


def matched_line(text: Column, folded: Column, rule: Column) -> Column:
    """The line that holds the rule's first match, '' when nothing matches.

    The first line with one of the rule's literals is the earliest that can
    match, and almost always does; only otherwise is the whole text searched.
    Folding maps character to character, so positions agree.
    """
    found = F.filter(F.transform(rule["first"], lambda t: F.instr(folded, t)), lambda p: p > 0)
    anywhere = F.call_function("regexp_extract", text, rule["line_regex"], F.lit(0))
    return let(
        F.array_min(found),
        lambda position: F.when(position.isNull(), anywhere).otherwise(
            let(
                line_at(text, position),
                lambda line: F.when(F.rlike(line, rule["regex"]), line).otherwise(anywhere),
            )
        ),
    )


def matching_rules(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """``array<struct<rule, category, weight, line>>``: rules that match, in order, each once.

    A substring search for the literals goes first, so that of the whole table
    only the few expressions likely to match run, and those over one line.
    """

    def likely(rule: Column, folded: Column) -> Column:
        return F.forall(rule["needs"], lambda choices: F.exists(choices, lambda c: F.contains(folded, c)))

    def hits(folded: Column) -> Column:
        tried = F.transform(
            F.filter(rule_array(rules), lambda r: likely(r, folded)),
            lambda r: F.struct(
                r["rule"].alias("rule"),
                r["category"].alias("category"),
                r["weight"].alias("weight"),
                utrim(matched_line(text, folded, r)).alias("line"),
            ),
        )
        return F.filter(tried, lambda m: m["line"] != "")

    return let(fold_for_search(text), hits)
