"""Exact text semantics on built-in, code-generated Spark functions.

Strings are compared by byte, trimmed by Unicode white space and measured in
UTF-8 bytes unless a name says otherwise.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space code points.
SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
NEWLINE = "\n"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once however often it is used.

    A chain of derived columns would do the same until a filter is pushed
    through it, which pastes every definition into every use. One bound
    expression stays as small as it was written.
    """
    return F.transform(F.array(value), body)[0]


def constant(value: object, schema: str) -> Column:
    """A nested constant as one literal of the plan, folded before execution."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def text_or_empty(c: Column | str) -> Column:
    """Null and the empty string behave alike in every key column."""
    return F.coalesce(col(c), F.lit(""))


def utrim(c: Column | str) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.btrim(col(c), F.lit(SPACE))


def is_blank(c: Column | str) -> Column:
    return utrim(text_or_empty(c)) == ""


def simple_lower(c: Column | str) -> Column:
    """Lower-case code point by code point.

    Full case mapping turns U+0130 into two code points; simple mapping gives a
    plain ``i``. ``replace`` returns its input untouched when nothing matches.
    """
    return F.lower(F.replace(col(c), F.lit("\u0130"), F.lit("i")))


def fold_for_search(c: Column | str) -> Column:
    """Simple lower case, and the long s as ``s``; as many characters as before."""
    return F.replace(simple_lower(c), F.lit("\u017f"), F.lit("s"))


def newlines(c: Column | str) -> Column:
    """Number of line feeds; the number of lines is one more."""
    c = col(c)
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(NEWLINE), F.lit("")))


def first_lines(c: Column | str, n: Column | int) -> Column:
    """The first n lines (n >= 1), the whole text if it has no more than n."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.call_function("substring_index", col(c), F.lit(NEWLINE), n)


def drop_lines(c: Column | str, n: Column) -> Column:
    """The text after its first n lines; callers keep n below the line count."""
    c = col(c)
    return F.when(n <= 0, c).otherwise(F.substring(c, F.length(first_lines(c, n)) + F.lit(2), F.length(c)))


def short_hash(*parts: Column | str) -> Column:
    """First 12 hex digits of SHA-256 over the parts, each closed by a NUL."""
    closed = [F.concat(text_or_empty(p), F.lit("\0")) for p in parts]
    return F.substring(F.sha2(F.encode(F.concat(*closed), "UTF-8"), 256), 1, 12)


def short_commit(c: Column | str) -> Column:
    return F.left(col(c), F.lit(7))


def percent(rate: Column | str) -> Column:
    """Whole percent, rounded half to even on the exact binary value."""
    return F.concat(F.format_number(col(rate) * 100, 0), F.lit("%"))


def two_places(c: Column | str) -> Column:
    return F.format_number(col(c), 2)


def first_sentence(c: Column | str) -> Column:
    """Through the first of ``.``, ``!``, ``?`` unless that opens the text."""
    trimmed = utrim(c)
    head = F.regexp_extract(trimmed, r"(?s)^[^.!?]+[.!?]", 0)
    return F.when(head == "", trimmed).otherwise(head)
