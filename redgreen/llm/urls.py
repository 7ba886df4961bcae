"""URL filters: rules first, then a model of segmented host names and path tokens.

Host names are concatenated words. A unigram model counted over the visible
text of all pages segments every distinct host by Viterbi: a host's substrings
meet the word counts in a join, so no vocabulary is held by a task, and the
best path is found per host. A multinomial naive Bayes over host words and path
tokens, learned from the pages that the rules decide, judges the others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redgreen.llm.support import durable, pick, ship

# Longest word of the unigram model; longer runs of letters in a page are no words of it.
LONGEST_WORD = 24
# Tokens of the classifier are hashed into this many slots.
SLOTS = 1 << 18

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a text without ``://``."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    return F.when(known, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(known, path).otherwise("")


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits.

    A rule ``host/path`` fits its host and subdomains if the path starts with
    the rule's. Of equally long rules the first given wins. Rules become part
    of the plan, so this is meant for lists, not for tables.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i in sorted(range(len(rules)), key=lambda i: (len(rules[i][1]), -i)):
        decision, text = rules[i]
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame) -> DataFrame:
    """``(word, n)``: lower-cased runs of letters in the visible text of all pages."""
    text = F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<(script|style)\b.*?</\1\s*>|<[^>]*>", " "))
    words = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word"))
    return words.where(F.length("word").between(1, LONGEST_WORD)).groupBy("word").agg(F.count("*").alias("n"))


def best_words(host: str, arcs: list[tuple[int, int, int]], total: int) -> list[str]:
    """The likeliest words of a host; dots, hyphens and other marks separate.

    ``arcs`` are (start, length, count) of known words. An unknown run of n
    characters weighs 1 / (total * 10^n), so it is kept whole where nothing
    known explains it better. Of equal paths the one with the longer last word wins.
    """
    log = np.log
    known: dict[int, list[tuple[int, float]]] = {}
    for start, length, n in arcs:
        known.setdefault(start + length, []).append((start, float(log(n / (total + 1)))))
    words: list[str] = []
    start = 0
    for end in range(len(host) + 1):
        if end < len(host) and host[end].isalnum():
            continue
        if end > start:
            best, back = [0.0] + [-np.inf] * (end - start), [0] * (end - start + 1)
            for j in range(1, end - start + 1):
                for i in range(max(0, j - LONGEST_WORD), j):
                    value = best[i] - float(log(total + 1)) - (j - i) * float(log(10))
                    if value > best[j]:
                        best[j], back[j] = value, i
                for at, weight in known.get(start + j, ()):
                    if at >= start and best[at - start] + weight >= best[j]:
                        best[j], back[j] = best[at - start] + weight, at - start
            cut, j = [], end - start
            while j:
                cut.append(host[start + back[j] : start + j])
                j = back[j]
            words += cut[::-1]
        start = end + 1
    return words


def segment_hosts(hosts: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """``(host, words)`` of every distinct non-empty host."""
    ship(hosts.sparkSession)
    distinct = hosts.where("host <> ''").select("host").distinct()
    starts = distinct.select("host", F.explode(F.sequence(F.lit(1), F.length("host"))).alias("start"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("host") - F.col("start") + 1))
    parts = starts.select("host", "start", F.explode(lengths).alias("length"))
    parts = parts.withColumn("word", F.substring(F.col("host"), F.col("start"), F.col("length"))).where(~F.col("word").rlike(r"[^\p{L}]"))
    # What a host collects is bounded by its own length.
    arcs = parts.join(counts, "word").groupBy("host").agg(F.collect_list(F.struct(F.col("start") - 1, "length", "n")).alias("arcs"))
    both = distinct.join(arcs, "host", "left")

    @F.arrow_udf("array<string>")
    def cut(host: pa.Array, arcs: pa.Array) -> pa.Array:
        from redgreen.llm import urls as m

        lines = zip(host.to_pylist(), arcs.to_pylist())
        return pa.array([m.best_words(h, [tuple(x.values()) for x in a or []], total) for h, a in lines], pa.list_(pa.string()))

    return both.select("host", cut("host", "arcs").alias("words"))


def page_slots(words: Column, path: Column) -> Column:
    """Hashed tokens of a page: its host's words, and its path's, with numbers told apart by length only."""
    tokens = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    tokens = F.transform(tokens, lambda t: F.when(t.rlike(r"^\p{N}+$"), F.concat(F.lit("#"), F.length(t))).otherwise(t))
    hosts = F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w))
    both = F.concat(hosts, F.transform(tokens, lambda t: F.concat(F.lit("p:"), t)))
    return F.transform(both, lambda t: F.pmod(F.xxhash64(t), F.lit(SLOTS)).cast("int"))


def train_bayes(decided: DataFrame) -> np.ndarray:
    """Log odds of block over allow per slot, with the prior last, from ``(slots, verdict)``."""
    blocked = (F.col("verdict") == "block").cast("long")
    priors = decided.agg(F.coalesce(F.sum(blocked), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    rows = decided.select(F.explode("slots").alias("slot"), blocked.alias("b")).groupBy("slot").agg(
        F.sum("b").alias("b"), F.sum(1 - F.col("b")).alias("a")
    )
    b, a = np.ones(SLOTS), np.ones(SLOTS)
    for row in rows.collect():  # one row per slot at most
        b[row["slot"]] += row["b"]
        a[row["slot"]] += row["a"]
    odds = np.log(b / b.sum()) - np.log(a / a.sum())
    return np.append(odds, np.log((priors["b"] + 1) / (priors["n"] - priors["b"] + 1)))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per input row.

    The verdict is the longest fitting rule's, else the classifier's: block if
    its log odds are above zero, allow otherwise (so also for an empty host and
    path, unless blocked pages outnumber allowed ones, and where no page fits
    any rule). Null ids, null urls and repeated rows are judged like others; an
    empty table gives no rows.
    """
    spark = pages.sparkSession
    ship(spark)
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col)
    host, path = url_parts(F.col("url"))
    parsed = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    parsed = durable(parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict")), "urls")
    counts = durable(word_counts(rows), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    words = durable(segment_hosts(parsed, counts, total), "hosts")
    # A hot host's rows are split by the engine: the hosts' side has one row for it.
    slots = parsed.join(words, "host", "left").withColumn("slots", page_slots(F.col("words"), F.col("path"))).drop("words")
    odds = train_bayes(slots.where("verdict is not null"))
    shared = spark.sparkContext.broadcast(odds)

    @F.arrow_udf("boolean")
    def blocked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for batch in batches:
            yield pa.array([bool(model[line].sum() + model[-1] > 0) if line else bool(model[-1] > 0) for line in batch.to_pylist()])

    guess = F.when(blocked("slots"), F.lit("block")).otherwise("allow")
    return slots.select("page_id", "host", "path", "rule", F.coalesce("verdict", guess).alias("verdict"))
