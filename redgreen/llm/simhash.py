"""Document fingerprints by SimHash, with DataFrame functions only.

A text's terms are its pairs of neighbouring words (a single word is a term
alone). Every occurrence of a term votes with its weight, the number of its
characters, for or against each of 64 bits of the term's hash; a bit is set if
the votes for it outweigh. Votes for two bits are counted in one long, 32 bits
each, which no text can fill.

Fingerprints within a Hamming radius r are found exactly: with the 64 bits cut
into r + k blocks, at least k blocks of two such fingerprints are equal, so
they meet in the table permuted by those k blocks. For a wide radius there are
few blocks and a table for each, which is asked for every key within some flips
of the query's.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redgreen.llm.support import durable, pick, reread

BLANKS = r"[\x20\x09-\x0D]+"
# Cut points at most, and rows aimed at between two of them, when documents are dealt out in id order.
CUTS = 1024
ROWS_BETWEEN = 2000
# A radius that holds near copies: distinct texts of sf0.1 with a five-word Jaccard of 0.8 or more differ in 11 bits at most.
NEAR_COPIES = 12
# The widest radius that is searched by equal blocks; beyond it keys are flipped.
EQUAL_BLOCKS = 3
# Values under one key up to this number meet their queries in one task; more are dealt out.
HOT_KEY = 4096
# The position of rows without an id: before all others.
FIRST = -(2**63)


def terms(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """``keys`` and ``(a, b)``: one row per neighbouring words a, b; b is null for a single word.

    A text without words gives one row with an empty a.
    """
    words = F.split(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, " ")), " ")
    named = rows.select(*keys, words.alias("_words"))
    n = F.size("_words")
    pairs = F.arrays_zip(
        F.slice("_words", F.lit(1), F.greatest(n - 1, F.lit(1))).alias("a"), F.slice("_words", F.lit(2), F.greatest(n - 1, F.lit(1))).alias("b")
    )
    return named.select(*keys, F.inline(pairs))


def fingerprints(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """``keys`` and ``fp`` (long): the SimHash of the text of each distinct ``keys``.

    Votes are summed where the text is read; one row per text is shuffled.
    Texts that are null, empty or blank have the fingerprint 0.
    """
    voted = terms(rows, text, *keys).select(
        *keys, F.xxhash64("a", "b").alias("_h"), (F.length("a") + F.coalesce(F.length("b"), F.lit(0))).cast("long").alias("_w")
    )
    mask = F.lit(0x0000000100000001)
    votes = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(mask) * F.col("_w")).alias(f"_v{i}") for i in range(32)]
    summed = voted.groupBy(*keys).agg(F.sum("_w").alias("_total"), *votes)
    fp = F.lit(0).cast("long")
    for i in range(32):
        low = F.col(f"_v{i}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(f"_v{i}", 32)
        for votes_for, bit in ((low, i), (high, i + 32)):
            fp = fp.bitwiseOR(F.when(2 * votes_for > F.col("_total"), F.lit(1 << bit if bit < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
    return summed.select(*keys, fp.alias("fp"))


def distance(x: Column, y: Column) -> Column:
    """Hamming distance of two 64-bit fingerprints."""
    return F.bit_count(x.bitwiseXOR(y))


def as_text(fp: Column) -> Column:
    """Sixteen hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_fingerprints(queries: DataFrame, rows: DataFrame, radius: int = 3, same: int = 3) -> DataFrame:
    """``(query, fp)``: every pair of distinct fingerprint values within ``radius``.

    Both sides are tables with a column ``fp``. There is one table for each
    choice of ``same`` among ``radius + same`` blocks; a pair that meets in several tables is
    given by the first of them only, so nothing needs to be deduplicated.
    Values, not rows, meet: copies cost nothing. Null fingerprints take no part.
    """
    blocks = radius + same
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    tables = list(combinations(range(blocks), same))

    def permuted(df: DataFrame, name: str) -> DataFrame:
        fp = F.col("fp")
        keys = F.array(*[F.struct(F.lit(t).alias("table"), _masked(fp, chosen, signed).alias("key")) for t, chosen in enumerate(tables)])
        distinct = df.where("fp is not null").select("fp").distinct()
        return distinct.select(fp.alias(name), F.inline(keys))

    met = permuted(queries, "query").join(permuted(rows, "fp"), ["table", "key"])
    equal = [F.col("query").bitwiseXOR(F.col("fp")).bitwiseAND(F.lit(m)) == 0 for m in signed]
    first = F.lit(-1)
    for t in reversed(range(len(tables))):
        hit = equal[tables[t][0]]
        for i in tables[t][1:]:
            hit = hit & equal[i]
        first = F.when(hit, F.lit(t)).otherwise(first)
    return met.where((distance(F.col("query"), F.col("fp")) <= radius) & (F.col("table") == first)).select("query", "fp")


def near_by_flips(queries: DataFrame, rows: DataFrame, radius: int, blocks: int = 4) -> DataFrame:
    """What ``near_fingerprints`` gives, for a wide radius.

    There is a table for each of ``blocks`` blocks. The bits that may differ in
    each add up to ``radius + 1 - blocks``, so a pair within ``radius`` has no
    more than its share in one block at least, and meets in that block's table
    as the query asks for every key with so many bits flipped. Keys that many
    values share are dealt into parts, and their queries go to each part.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    spare = radius + 1 - blocks
    shares = [(spare + blocks - 1 - i) // blocks for i in range(blocks)]  # below zero: the block's table is not needed
    kept = [i for i in range(blocks) if shares[i] >= 0]

    def signed(x: int) -> int:
        return x - (1 << 64) if x >= 1 << 63 else x

    def flips(i: int) -> Column:
        bits = range(edges[i], edges[i + 1])
        chosen = [sum(1 << b for b in some) for n in range(min(shares[i], len(bits)) + 1) for some in combinations(bits, n)]
        return F.from_json(F.lit(str([signed(x) for x in chosen])), "array<bigint>")

    fp = F.col("fp")

    def tables(df: DataFrame, name: str) -> DataFrame:
        keys = [F.struct(F.lit(i).alias("table"), fp.bitwiseAND(F.lit(signed(masks[i]))).alias("key")) for i in kept]
        return df.where("fp is not null").select("fp").distinct().select(fp.alias(name), F.inline(F.array(*keys)))

    held = tables(rows, "fp")
    parts = F.ceil(F.count("*") / HOT_KEY).cast("int")
    # One row per HOT_KEY values at most, and per key of a block.
    hot = F.broadcast(durable(held.groupBy("table", "key").agg(parts.alias("parts")).where("parts > 1"), "hot"))
    held = held.join(hot, ["table", "key"], "left").withColumn("part", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int"))
    by_table = F.create_map(*[x for i in kept for x in (F.lit(i), flips(i))])
    asked = tables(queries, "query").select("query", "table", "key", F.explode(by_table[F.col("table")]).alias("flip"))
    asked = asked.select("query", "table", F.col("key").bitwiseXOR(F.col("flip")).alias("key")).join(hot, ["table", "key"], "left")
    asked = asked.select("query", "table", "key", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    # Both sides are small when compressed and large in memory: neither must be broadcast for its size on disk.
    met = asked.join(held.select("fp", "table", "key", "part").hint("merge"), ["table", "key", "part"])
    differing = F.col("query").bitwiseXOR(F.col("fp"))
    first = F.lit(-1)
    for i in reversed(kept):
        first = F.when(F.bit_count(differing.bitwiseAND(F.lit(signed(masks[i])))) <= shares[i], F.lit(i)).otherwise(first)
    return met.where((F.bit_count(differing) <= radius) & (F.col("table") == first)).select("query", "fp")


def _masked(fp: Column, chosen: tuple[int, ...], masks: list[int]) -> Column:
    both = 0
    for i in chosen:
        both |= masks[i] & (1 << 64) - 1
    return fp.bitwiseAND(F.lit(both - (1 << 64) if both >= 1 << 63 else both))


def with_next(rows: DataFrame) -> DataFrame:
    """Every row of ``(doc_id, text)`` with the text of the next by ascending ``doc_id``; after the last, the first.

    The order is total over all rows but no task sorts them all: quantiles of
    the ids cut it into ranges, and the first row of each range also goes to
    the end of the range before it. Rows without an id come first; rows that
    share an id are ordered by their text. ``(range, n)`` numbers the rows
    uniquely, ``(next_range, next_n)`` is the number of the next; ``next`` is its text.
    """
    placed = rows.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("at"))
    pieces = max(1, min(CUTS, placed.count() // ROWS_BETWEEN))
    cuts: list[int] = []
    if pieces > 1:
        shares = [i / pieces for i in range(1, pieces)]
        cuts = sorted(set(placed.agg(F.percentile_approx("at", shares, 10 * pieces).alias("c")).first()["c"]))
    table = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    ranged = placed.withColumn("range", F.size(F.filter(table, lambda c: c <= F.col("at"))))
    # One number per range, CUTS at most.
    firsts = sorted((r["range"], r["least"]) for r in ranged.groupBy("range").agg(F.min("at").alias("least")).collect())

    def lookup(pairs: list[tuple[int, int]], key: str, kind: str) -> Column:
        return F.create_map(*[F.lit(x) for pair in pairs for x in pair]).cast(f"map<{kind}, int>")[F.col(key)]

    into = lookup([(least, firsts[i - 1][0]) for i, (_, least) in enumerate(firsts)], "at", "bigint")
    after = lookup([(firsts[i - 1][0], number) for i, (number, _) in enumerate(firsts)], "range", "int")
    copies = F.array(
        F.struct(F.col("range").alias("range"), F.lit(0).alias("late")),
        F.when(into.isNotNull(), F.struct(into.alias("range"), F.lit(1).alias("late"))),
    )
    dealt = ranged.select("doc_id", "text", "at", F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("c"))
    # The id takes part in the order so that all uses of the rows share one shuffle.
    order = Window.partitionBy("range").orderBy("late", "at", "doc_id", "text")
    lined = dealt.select("doc_id", "text", "at", "c.range", "c.late").withColumns(
        {"n": F.row_number().over(order), "next": F.lead("text").over(order), "_next_late": F.lead("late").over(order)}
    )
    last = F.col("_next_late") == 1
    return lined.where("late = 0").select(
        "range", "n", "doc_id", "text", "next",
        F.when(last, after).otherwise(F.col("range")).alias("next_range"), F.when(last, 1).otherwise(F.col("n") + 1).alias("next_n"),
    )


def edited(text: Column, following: Column) -> Column:
    """The last quarter of a text (its floor in characters) replaced by as much of the following text, or all of it."""
    n = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - n), F.substring(following, F.lit(1), n))


def compare_edits(documents: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are; one row per input row.

    Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next`` and ``n_near``: for rows whose id is divisible by
    20 the number of other rows within ``radius``, null for the others. Null
    texts count as empty; likeness is the share of equal bits. The next of the
    last row is the first, so a single row is its own next. An empty table
    gives no rows.
    """
    lined = with_next(pick(documents, doc_id=id_col, text=text_col))
    text, following = F.coalesce("text", F.lit("")), F.coalesce("next", F.lit(""))
    made = lined.select("range", "n", "doc_id", "next_range", "next_n", text.alias("text"), edited(text, following).alias("edited"))
    meta = made.select("range", "n", "doc_id", "next_range", "next_n", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    both = made.select("range", "n", F.posexplode(F.array("text", "edited")).alias("which", "body"))
    prints = fingerprints(both, "body", "range", "n", "which")
    prints = prints.groupBy("range", "n").agg(
        F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp")
    )
    table = durable(meta.join(prints, ["range", "n"]), "fingerprints")
    search = near_fingerprints if radius <= EQUAL_BLOCKS else near_by_flips
    near = search(table.where("doc_id % 20 = 0"), reread(table), radius)
    sizes = reread(table).groupBy("fp").agg(F.count("*").alias("rows"))
    counts = near.join(sizes, "fp").groupBy("query").agg(F.sum("rows").alias("rows"))
    following = reread(table).select(F.col("range").alias("next_range"), F.col("n").alias("next_n"), F.col("fp").alias("next_fp"))
    joined = reread(table).join(following, ["next_range", "next_n"]).join(counts, F.col("fp") == F.col("query"), "left")
    like = lambda x, y: 1 - distance(F.col(x), F.col(y)) / 64
    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        like("fp", "edited_fp").alias("near_edited"),
        like("fp", "next_fp").alias("near_next"),
        F.when(F.col("doc_id") % 20 == 0, F.col("rows") - 1).alias("n_near"),
    )
