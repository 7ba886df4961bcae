"""Removal of repeated passages, by parsing the corpus at minima of a rolling hash.

Texts are sequences of bytes, or of words; what is said of bytes here holds for
words too. A rolling hash of ``TRIGGER`` bytes picks the phrase starts: every window of
``length`` bytes is assigned to the position, among its first five eighths, where that
hash is smallest (the leftmost of equal ones). The choice depends on the
window's own bytes only, so equal windows are parsed alike wherever they stand.
Windows of one phrase start that follow each other form a run.

This stands in for the phrases and the suffix arrays of prefix-free parsing:
what a suffix order would be asked is only which suffixes agree in their first
``length`` bytes. So the dictionary and the parse are kept as classes of equal
strings, by 64-bit hashes of the bytes:

1. The dictionary holds each phrase start's first bytes, those that all of its
   windows share. Starts whose string occurs once are dropped: none of their
   windows repeats. This leaves little more than what does repeat.
2. The parse: runs that agree from their first window's start to their last
   window's end are one class. All windows of a class with two members repeat.
3. Where one dictionary string continues or begins in several ways, passages
   begin or end inside a run. Each class, not each member, then gives the
   hashes of its single windows, and those that occur twice repeat.

Runs of one class in one text, as repetitive texts have them, are one row with
their number. Counts are combined before every shuffle, classes stand for all of their
members, and no group is ever collected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redgreen.llm.minhash import word_hashes
from redgreen.llm.support import discard, durable, fresh, pick, reread, ship, tidy

TRIGGER = 16
# The same for words.
WORD_TRIGGER = 2
# Bytes parsed at once: several documents, or one that is longer.
BUFFER = 1 << 19
# Rows of positions up to this number are sent to all tasks (some 30 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_MULTIPLIER = 0x9E3779B97F4A7C15
_RANDOM = np.random.default_rng(20240611)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Symbols:
    """A text as a sequence: the bytes of its UTF-8, or its words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased."""

    def __init__(self, words: bool):
        self.words = words
        self.memory: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        """A number for each symbol."""
        if self.words:
            return word_hashes(text, self.memory) | np.uint64(1)
        return _BYTE[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)]


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def in_bytes(body: bytes, stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of words as stretches of bytes: from a first word's start to a last word's end."""
    if not stretches:
        return []
    ends = [m.span() for m in _WORD.finditer(body)]
    return [(ends[start][0], ends[end - 1][1]) for start, end in stretches]


class Hashes:
    """Hashes of all substrings of a sequence: sums of symbols times powers, shifted back to the start."""

    _powers = np.ones(1, dtype=np.uint64)
    _inverse = np.ones(1, dtype=np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Hashes._powers) < n + 1:
            factors = np.full(n + 1, _MULTIPLIER, dtype=np.uint64)
            factors[0] = 1
            Hashes._powers = np.multiply.accumulate(factors)
            factors[1:] = pow(_MULTIPLIER, -1, 1 << 64)
            Hashes._inverse = np.multiply.accumulate(factors)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(data * Hashes._powers[:n], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Of every substring of one length, unmixed."""
        return (self.sums[length:] - self.sums[:-length]) * Hashes._inverse[: len(self.sums) - length]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Hashes._inverse[start])


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum among every ``width`` neighbouring values."""
    n = len(values) - width + 1
    # The position takes the low half: of equal upper halves the leftmost is smaller, whatever the buffer.
    low = np.uint64(0xFFFFFFFF)
    keyed = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(values)] = keyed
    squares = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(squares, axis=1).ravel()
    backward = np.minimum.accumulate(squares[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(backward[:n], forward[width - 1 : width - 1 + n]) & low).astype(np.int64)


def width(length: int, trigger: int = TRIGGER) -> int:
    """How many of a window's first positions its phrase start is chosen from.

    The more there are, the fewer phrases a text has; what is left of the
    window is its dictionary string, for which a few words are enough.
    """
    return max(1, (length - trigger) * (15 if trigger == WORD_TRIGGER else 10) // 16)


def parse(texts: list[np.ndarray], length: int, trigger: int = TRIGGER) -> tuple[np.ndarray, ...]:
    """Runs of windows: text number, first and last start in the text, dictionary and class hash."""
    reach = width(length, trigger)
    ends = np.cumsum([len(t) for t in texts])
    data = np.concatenate(texts) if texts else np.empty(0, dtype=np.uint64)
    none = np.empty(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none, none
    hashes = Hashes(data)
    at = smallest(mix(hashes.every(min(trigger, length))), reach)[: len(data) - length + 1]
    inside = np.zeros(len(at) + 1, dtype=bool)
    owner = np.empty(len(at), dtype=np.int32)
    for i, (start, end) in enumerate(zip(ends - [len(t) for t in texts], ends)):
        inside[start : max(start, end - length + 1)] = True
        owner[start:end] = i
    inside = inside[: len(at)]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    anchor, text = at[first], owner[first]
    begin = (ends - [len(t) for t in texts])[text]
    word = hashes.of(anchor, anchor + (length - reach + 1))
    whole = mix(hashes.of(first, stop + length) + np.uint64(_MULTIPLIER) * (stop - first + 1).astype(np.uint64) + mix((anchor - first).astype(np.uint64) + np.uint64(7)))
    return text, first - begin, stop - begin, word.view(np.int64), whole.view(np.int64)


def alike(text: np.ndarray, lo: np.ndarray, hi: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, ...]:
    """First run and number of runs of each class of one text; text, first and last start of stretches of runs whose class the text has twice.

    A text that says one thing over and over has a run for each time. As they
    stand in several places, all of their windows repeat, and the first can
    stand for all before the other texts.
    """
    order = np.lexsort((lo, whole, text))
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (whole[order][1:] != whole[order][:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(text)))
    often = np.zeros(len(text), dtype=bool)
    often[order] = np.repeat(times > 1, times)
    joined = np.zeros(len(text) + 1, dtype=bool)  # with the run before
    joined[1:-1] = often[1:] & often[:-1] & (text[1:] == text[:-1]) & (lo[1:] == hi[:-1] + 1)
    begin, end = np.flatnonzero(often & ~joined[:-1]), np.flatnonzero(often & ~joined[1:])
    return order[at], times, text[begin], lo[begin], hi[end]


def keys_of(id_col: str, text_col: str) -> list[Column]:
    """Two hashes of id and text, which rows equal in both share and need to share."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return [F.xxhash64(F.col(f"`{id_col}`"), text), F.crc32(text.cast("binary"))]


def runs(rows: DataFrame, length: int, words: bool = False) -> DataFrame:
    """``(k1, k2, lo, hi, times, word, whole)`` of ``(k1, k2, text)``.

    A row is the first of ``times`` runs of one class in one text or, without
    ``word`` and ``whole``, a stretch of windows that stand in the text twice.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from redgreen.llm import passages as m

        symbols = m.Symbols(words)
        trigger, buffer = (m.WORD_TRIGGER, m.BUFFER // 4) if words else (m.TRIGGER, m.BUFFER)

        def table(keys: list[tuple], texts: list[np.ndarray]) -> pa.RecordBatch:
            number, lo, hi, word, whole = m.parse(texts, length, trigger)
            first, times, known, begin, end = m.alike(number, lo, hi, whole)
            k = np.array(keys, dtype=np.int64).reshape(-1, 2)[np.concatenate([number[first], known])]
            none = np.zeros(len(known), dtype=np.int64)
            numbers = [k[:, 0], k[:, 1], np.concatenate([lo[first], begin]), np.concatenate([hi[first], end]), np.concatenate([times, none])]
            blank = np.arange(len(k)) >= len(first)
            hashes = [pa.array(np.concatenate([x[first], none]), mask=blank) for x in (word, whole)]
            return pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int64)) for x in numbers], *hashes], ["k1", "k2", "lo", "hi", "times", "word", "whole"])

        keys, texts, size = [], [], 0
        for batch in batches:
            for k1, k2, text in zip(*batch.columns):
                body = symbols.of(text.as_py())
                if len(body) < length:
                    continue
                if size + len(body) > buffer and texts:
                    yield table(keys, texts)
                    keys, texts, size = [], [], 0
                keys.append((k1.as_py(), k2.as_py()))
                texts.append(body)
                size += len(body)
        if texts:
            yield table(keys, texts)

    return rows.mapInArrow(run, "k1 bigint, k2 bigint, lo bigint, hi bigint, times bigint, word bigint, whole bigint")


def windows(rows: DataFrame, length: int, reach: int, words: bool = False) -> DataFrame:
    """``(hash, place, unsure)``: every window of the runs that come with a text; place = run number * reach + offset."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from redgreen.llm import passages as m

        symbols = m.Symbols(words)
        for batch in batches:
            for text, spans in zip(*batch.columns):
                hashes = m.Hashes(symbols.of(text.as_py()))
                parts = [(s["lo"], s["hi"], s["run"], s["unsure"]) for s in spans.as_py()]
                starts = np.concatenate([np.arange(lo, hi + 1) for lo, hi, _, _ in parts])
                place = np.concatenate([number * reach + np.arange(hi - lo + 1) for lo, hi, number, _ in parts])
                unsure = np.concatenate([np.full(hi - lo + 1, u) for lo, hi, _, u in parts])
                found = hashes.of(starts, starts + length).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(place), pa.array(unsure)], ["hash", "place", "unsure"])

    return rows.select("text", "spans").mapInArrow(run, "hash bigint, place bigint, unsure boolean")


def small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def repeats(texts: DataFrame, length: int, words: bool = False) -> DataFrame:
    """``(k1, k2, start, end)``: the maximal stretches of bytes, or words, that repeated strings of ``length`` cover.

    ``texts`` is ``(k1, k2, text)``; rows equal in all three are texts of their own.
    """
    ship(texts.sparkSession)
    reach = width(length, WORD_TRIGGER if words else TRIGGER)
    parsed = durable(runs(texts, length, words), "runs")
    # Tables of their own: only where both sides of a join are read anew can the engine split a hot string's rows.
    dictionary = durable(parsed.where("word is not null").groupBy("word").agg(F.sum("times").alias("times")).where("times > 1").select("word"), "dictionary")
    known = durable(reread(parsed).where("word is null").select("k1", "k2", "lo", "hi"), "known")
    phrases = durable(reread(parsed).join(dictionary, "word", "left_semi"), "phrases")
    discard([parsed])
    classes = phrases.groupBy("whole").agg(
        F.sum("times").alias("members"), F.min("word").alias("word"), F.min(F.struct("k1", "k2", "lo", "hi")).alias("one")
    )
    classes = durable(classes, "classes")
    # Members of a class of several: all windows repeat.
    repeated = durable(reread(classes).where("members > 1").select("whole"), "repeated")
    sure = reread(phrases).where("times = 1").join(repeated, "whole", "left_semi").select("k1", "k2", "lo", "hi")
    # Strings that several classes share: single windows decide, one member for each class.
    several = durable(reread(classes).groupBy("word").agg(F.count("*").alias("kinds")).where("kinds > 1").select("word"), "several")
    open_runs = reread(classes).join(several, "word", "left_semi").select(
        F.monotonically_increasing_id().alias("run"), "one.*", (F.col("members") == 1).alias("unsure")
    )
    open_runs = durable(open_runs, "open")  # run numbers are fixed here
    wanted = durable(open_runs.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi", "run", "unsure")).alias("spans")), "wanted")
    sizes = wanted.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("spans"), F.count("*").alias("texts")).first()
    if sizes["spans"] > BROADCAST_ROWS and sizes["texts"] <= BROADCAST_ROWS:
        # Spans meet their texts in a shuffle, but no other text goes into it.
        texts = texts.join(F.broadcast(reread(wanted).select("k1", "k2")), ["k1", "k2"], "left_semi")
    # Rows equal in id and content share a key; only classes of several members can be theirs, so no unsure window counts twice.
    met = texts.join(small(wanted, sizes["spans"]), ["k1", "k2"]).select("text", "spans")
    # Of bytes made twice rather than kept: hashes are dear to store and cheap to compute. Words are few, and dear to find.
    made = durable(windows(met, length, reach, words), "windows") if words else windows(met, length, reach, words)
    twice = durable(made.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1").select("hash"), "twice")
    found = (reread(made) if words else made).where("unsure").join(twice, "hash", "left_semi")
    offsets = found.select(F.expr(f"place div {reach}").alias("run"), (F.col("place") % reach).alias("at"))
    line = Window.partitionBy("run").orderBy("at")  # a run has ``reach`` windows at most
    ranges = offsets.withColumn("island", F.col("at") - F.row_number().over(line)).groupBy("run", "island").agg(
        F.min("at").alias("low"), F.max("at").alias("high")
    )
    part = reread(open_runs).where("unsure").join(ranges, "run").select("k1", "k2", (F.col("lo") + F.col("low")).alias("lo"), (F.col("lo") + F.col("high")).alias("hi"))
    # Ranges of one text that touch or overlap in the bytes they cover become one stretch.
    order = Window.partitionBy("k1", "k2").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = known.union(sure).union(part).withColumn("new", F.coalesce(F.col("lo") > before + length, F.lit(True)).cast("int"))
    stretches = marked.withColumn("stretch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return stretches.groupBy("k1", "k2", "stretch").agg(F.min("lo").alias("start"), (F.max("hi") + length).alias("end")).drop("stretch")


def cut(body: bytes, stretches: list[tuple[int, int]]) -> bytes:
    """What is left of a text without some stretches."""
    at, kept = 0, []
    for start, end in sorted(stretches):
        kept.append(body[at:start])
        at = end
    return b"".join([*kept, body[at:]])


def with_stretches(documents: DataFrame, length: int, words: bool, id_col: str, text_col: str, spans_col: str) -> DataFrame:
    """All columns and ``spans_col``: the stretches of ``repeats`` in each text, null if it has none."""
    k1, k2 = fresh(documents, "_k1", "_k2")
    documents = documents.withColumns(dict(zip((k1, k2), keys_of(id_col, text_col))))
    texts = documents.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(f"`{text_col}`").alias("text"))
    # Too short a text has no such string and need not be read for it; a word and a blank are two bytes.
    spans = durable(repeats(texts.where(F.octet_length("text") >= (2 * length - 1 if words else length)), length, words), "spans")
    count = spans.count()
    # A row equal to another in id and content has that one's stretches too.
    spans = spans.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.collect_set(F.struct("start", "end")).alias(spans_col))
    return documents.join(small(spans, count), [k1, k2], "left").drop(k1, k2)


def remove_repeats(
    documents: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", kept_col: str = "kept", words: bool = False
) -> DataFrame:
    """All columns and ``kept_col``: ``struct<kept: binary, n_bytes, n_removed, n_spans>``.

    Every byte goes that lies in a ``length``-byte string which also starts at
    another place of the corpus, in the same text or another; all places lose
    it, the first too. Strings never cross texts and are judged on the input.
    With ``words``, strings are ``length`` words (A-Z lower-cased, whatever
    stands between them), and what goes is all from their first to their last.
    Null texts count as empty. Rows that repeat id and text are texts of their
    own, so they lose all their strings. An empty table gives an empty result.
    """
    (spans_col,) = fresh(documents, "_spans")
    met = with_stretches(documents, length, words, id_col, text_col, spans_col)

    @F.arrow_udf("struct<kept: binary, n_bytes: bigint, n_removed: bigint, n_spans: bigint>")
    @tidy
    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from redgreen.llm import passages as m

        for text, spans in batches:
            rows = []
            for body, places in zip(text, spans):
                body = (body.as_py() or "").encode("utf-8", "surrogatepass")
                stretches = [(s["start"], s["end"]) for s in places.as_py() or []]
                kept = m.cut(body, m.in_bytes(body, stretches) if words else stretches)
                rows.append((kept, len(body), len(body) - len(kept), len(stretches)))
            kinds = [("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])

    return met.withColumn(kept_col, apply(F.col(f"`{text_col}`"), F.col(spans_col))).drop(spans_col)


def whole_characters(body: str):
    """The text of a column of bytes, without bytes that make no whole character."""

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        return pa.array([None if b.as_py() is None else b.as_py().decode("utf-8", "ignore") for b in column], pa.string())

    return decode(body)


def digest(documents: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", passage_words: int = 51) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_words)`` of every row.

    ``n_passages`` counts the stretches of at least ``passage_words`` words
    that stand elsewhere too, however few bytes they have, and
    ``passage_words`` the words in them.
    """
    picked = pick(documents, doc_id=id_col, text=text_col)
    done = remove_repeats(with_stretches(picked, passage_words, True, "doc_id", "text", "passages"), length)
    covered = F.aggregate("passages", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select(
        "doc_id", "kept.n_bytes", "kept.n_removed", "kept.n_spans", F.sha2("kept.kept", 256).alias("kept_sha256"),
        F.coalesce(F.size("passages"), F.lit(0)).cast("long").alias("n_passages"), F.coalesce(covered, F.lit(0)).alias("passage_words"),
    )
