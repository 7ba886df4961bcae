import random

import pytest
from pyspark.sql import functions as F

from redgreen.functions import logs as l
from redgreen.functions import text as t


def test_trim_takes_all_unicode_space(value):
    assert value(t.utrim("x"), x="\u00a0\u2003\t a\u00a0b \u3000\r\n") == "a\u00a0b"
    assert value(t.utrim("x"), x="\u200ba") == "\u200ba"


def test_lowering_is_per_character(value):
    assert value(t.simple_lower("x"), x="FA\u0130LED \u212a") == "failed k"


@pytest.mark.parametrize(
    "text, first",
    [
        ("One. Two.", "One."), ("Why? Yes", "Why?"), ("no stop", "no stop"), (". leading", ". leading"),
        ("  Hey! ", "Hey!"), ("", ""), ("a\nb. c", "a\nb."),
    ],
)
def test_first_sentence(value, text, first):
    assert value(t.first_sentence("x"), x=text) == first


def test_rounding_follows_the_binary_value(value):
    assert value(t.two_places(F.lit(0.125))) == "0.12"
    assert value(t.two_places(F.lit(0.615))) == "0.61"
    assert value(t.percent(F.lit(0.125))) == "12%"
    assert value(t.percent(F.lit(1.0))) == "100%"


@pytest.mark.parametrize(
    "base, order, name",
    [
        ("3_Run tests.txt", 3, "Run tests"), ("Setup.txt", 0, "Setup"), ("_x.txt", 0, "_x"), ("x_y.txt", 0, "x_y"),
        ("-2_a_b.txt", -2, "a_b"), ("12_v1.2.txt", 12, "v1.2"), ("1_.txt", 1, ""),
        ("99999999999999999999_big.txt", 0, "99999999999999999999_big"),
    ],
)
def test_step_file_names(value, base, order, name):
    assert tuple(value(l.step_file("x"), x=base)) == (order, name)


def reference_strip(body):
    lines = body.replace("\r\n", "\n").split("\n")
    out = []
    for line in lines:
        b = line.encode()
        if len(b) > 28 and b[4:5] == b"-" and b[7:8] == b"-" and b[10:11] == b"T" and 0 < b.find(b" ") < 34:
            b = b[b.find(b" ") + 1:]
        out.append(b.decode())
    return "\n".join(out)


@pytest.mark.parametrize(
    "body",
    [
        "2026-01-01T10:00:00.1234567Z hello\r\n2026-01-01T10:00:00.1234567Z \r\nplain",
        "2026-01-01T10:00:00Z short",
        "2026-01-01T10:00:00Z long enough to be a stamped line",
        "2026-01-01T10:00:00.123456789012345678 too far",
        "2026-01-01T10:00:00.1234567Z  two blanks and é",
        "éé-01-0éT10:00:00.1234567Z bytes not characters",
        "éé-01-01T10:00:00.1234567Z bytes not characters",
        " 026-01-01T10:00:00.1234567Z leading blank here",
        "",
    ],
)
def test_stamps(value, body):
    assert value(l.strip_stamps("x"), x=body) == reference_strip(body)


def test_blank_runs_against_a_loop(spark):
    rng = random.Random(7)
    pieces = ["a", "", " ", "\t", "\u00a0", "\u3000 ", "b c", "\r", "\u2028"]
    bodies = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    bodies += ["\n" * 200000 + "x", "x" + "\n \n" * 50000]

    def collapse(body):
        out, blank = [], False
        for line in body.split("\n"):
            empty = line.strip(t.SPACE) == ""
            if not (empty and blank):
                out.append(line)
            blank = empty
        return "\n".join(out)

    rows = spark.createDataFrame([(b,) for b in bodies], "x string").select("x", l.collapse_blank_lines("x")).collect()
    assert all(r[1] == collapse(r[0]) for r in rows)


def test_short_hash_treats_null_as_empty(value):
    assert value(t.short_hash("x", F.lit(None).cast("string")), x="a") == value(t.short_hash("x", F.lit("")), x="a")
