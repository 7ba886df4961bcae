"""Column expressions over one log body (whole text in, text or number out).

Text is never split into line arrays: byte-level string built-ins and
linear-time regular expressions pass over it a fixed number of times.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redgreen.functions.text import (
    SPACE,
    col,
    drop_lines,
    first_lines,
    let,
    newlines,
    simple_lower,
    text_or_empty,
)

# Markers that pin the excerpt window.
ANCHOR_MARKERS = [
    "##[error]",
    "panic:",
    "data race",
    "fatal error:",
    "--- fail:",
    "process completed with exit code",
    "assertion failed",
    "traceback (most recent call last)",
]

# Markers that score a step, most specific first (11 points down to 1).
FAILURE_MARKERS = [
    "##[error]",
    "process completed with exit code",
    "panic:",
    "data race",
    "fatal error:",
    "--- fail:",
    "error:",
    "failed",
    "assertion",
    "timeout",
    "exception",
]

# Notices put where an excerpt leaves text out.
ELISION = "\n\n... [log truncated] ...\n\n"
DROPPED_HEAD = "... [head of excerpt dropped to fit budget] ...\n"

_INLINE_SPACE = "[" + SPACE.replace("\n", "") + "]"
_BLANK_RUN = rf"\n({_INLINE_SPACE}*+)(?:\n{_INLINE_SPACE}*+(?![^\n]))++"
_STAMP = r"(?md)^(?=[^\n]{29})(?=[^\n]{4}-[^\n]{2}-[^\n]{2}T)[^ \n]{1,33} "


def strip_stamps(body: Column | str) -> Column:
    """CRLF to LF, and drop the leading timestamp token of every stamped line.

    A line is stamped when it is longer than 28 bytes, has ``-``, ``-`` and
    ``T`` at byte offsets 4, 7 and 10, and its first blank within 34 bytes.
    Offsets are bytes, so text beyond ASCII is matched through a one-byte view.
    """
    body = F.replace(col(body), F.lit("\r\n"), F.lit("\n"))
    one_byte = F.decode(F.encode(body, "UTF-8"), "ISO-8859-1")
    through_bytes = F.decode(F.encode(F.regexp_replace(one_byte, _STAMP, ""), "ISO-8859-1"), "UTF-8")
    return F.when(F.octet_length(body) == F.length(body), F.regexp_replace(body, _STAMP, "")).otherwise(through_bytes)


def step_file(base: Column | str) -> Column:
    """``3_Run tests.txt`` to ``struct(step_order 3, step_name 'Run tests')``.

    Without an integer before the first underscore the order is 0 and the name
    is the whole stem. Only the last extension is dropped.
    """
    stem = F.regexp_replace(col(base), r"(?s)\.[^.]*\z", "")
    order = F.regexp_extract(stem, r"^([+-]?[0-9]+)_", 1).try_cast("bigint")
    name = F.when(order.isNull(), stem).otherwise(F.regexp_replace(stem, r"^[+-]?[0-9]+_", ""))
    return F.struct(F.coalesce(order, F.lit(0).cast("bigint")).alias("step_order"), name.alias("step_name"))


def collapse_blank_lines(body: Column | str) -> Column:
    """Keep only the first line of every run of blank lines.

    A run is searched from the line feed before it, which the text's first
    line borrows; possessive loops neither backtrack nor recurse.
    """
    led = F.regexp_replace(F.concat(F.lit("\n"), col(body)), _BLANK_RUN, "\n$1")
    return let(led, lambda t: F.substring(t, F.lit(2), F.length(t)))


def failure_score(step_name: Column | str, body: Column | str) -> Column:
    """How strongly a step looks like the failing one; 0 for housekeeping steps."""
    name = simple_lower(text_or_empty(step_name))
    housekeeping = F.startswith(name, F.lit("post ")) | (name == "complete job")

    def points(lowered: Column) -> Column:
        total = F.lit(0)
        for i, marker in enumerate(FAILURE_MARKERS):
            worth = len(FAILURE_MARKERS) - i
            total = total + F.when(F.contains(lowered, F.lit(marker)), F.lit(worth)).otherwise(F.lit(0))
        return total

    return F.when(housekeeping, F.lit(0)).otherwise(let(simple_lower(text_or_empty(body)), points))


def anchor_line(body: Column) -> Column:
    """0-based index of the last line holding an anchor marker, null without one.

    A marker never spans lines, so the shortest text after any marker's last
    occurrence belongs to the last line that holds one.
    """

    def located(lowered: Column) -> Column:
        rests = F.array(*[F.substring_index(lowered, marker, -1) for marker in ANCHOR_MARKERS])
        sized = F.transform(rests, lambda r: F.struct(F.octet_length(r).alias("size"), r.alias("rest")))
        return let(
            F.array_min(sized),
            lambda last: F.when(
                last["size"] < F.octet_length(lowered), newlines(lowered) - newlines(last["rest"])
            ),
        )

    return let(simple_lower(body), located)


def head_lines(body: Column, n: int) -> Column:
    """First n lines, or '' when the body has no more than n."""
    if n <= 0:
        return F.lit("")
    return let(
        first_lines(body, n), lambda head: F.when(F.octet_length(head) < F.octet_length(body), head).otherwise(F.lit(""))
    )


def window_around(body: Column, anchor: Column, before: int, after: int) -> Column:
    """Lines ``anchor - before`` to ``anchor + after``, clipped to the body."""
    return let(first_lines(body, anchor + F.lit(after + 1)), lambda upto: drop_lines(upto, anchor - F.lit(before)))


def error_block(body: Column, before: int, after: int) -> Column:
    """``struct(anchor, block)``: the window around the anchor, the whole body without one."""
    return let(
        anchor_line(body),
        lambda anchor: F.struct(
            anchor.alias("anchor"),
            F.when(anchor.isNull(), body).otherwise(window_around(body, anchor, before, after)).alias("block"),
        ),
    )
