"""The corpus pipeline: documents through the stages of ``STAGES``, in order.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one
before it kept; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redgreen.llm import bpe, minhash, mixing, passages, quality
from redgreen.llm.queries import RANKS, mixture_weights, source_domain
from redgreen.llm.support import durable, reread

# Words of a passage that may stand in one place only.
PASSAGE_WORDS = 51
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def plainly(stage: Stage) -> Stage:
    """A stage that sees other columns under names of their own, so that none clashes with a derived one."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in KNOWN and docs.columns.index(c) == i else f"other{i}" for i, c in enumerate(docs.columns)]
        done = stage(spark, docs.toDF(*names), sf_dir)
        back = dict(zip(names, docs.columns))
        derived = {c.lower() for c in done.columns if c not in back}
        # A column named like one that the stage adds comes back with an underscore after it.
        return done.toDF(*[back[c] + "_" * (back[c].lower() in derived) if c in back else c for c in done.columns])

    return run


@plainly
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labelled documents that are not held out."""
    weights = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, weights, least=0.3)


@plainly
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id (no id comes last), then of the smallest row number.

    Rows, not ids, are linked, each by a number of its own; rows that share an
    id and differ in their texts all stay. Rows without words stay, but for
    those that repeat both the id and the text of another.
    """
    rows = durable(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")  # numbers are fixed here
    found = durable(minhash.near_duplicates(rows, words=5, percent=80, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id"), "near")
    ids = reread(rows).select("_row", "doc_id")
    heads = found.join(ids, "_row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("head")).select("head._row")
    # Joined by row numbers, so that a large group is not lined up in one task.
    copies = reread(found).select("_row").join(heads, "_row", "left_anti")
    blank = reread(rows).where("doc_id is not null").where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("_row", "doc_id", "text")
    first = blank.groupBy("doc_id", "text").agg(F.min("_row").alias("_row")).select("_row")
    repeated = blank.select("_row").join(first, "_row", "left_anti")
    gone = durable(copies.union(repeated), "dropped")
    return reread(rows).join(minhash.few(gone), "_row", "left_anti").select(*docs.columns)


@plainly
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in several places; ``n_chars`` follows the text.

    Characters of which a part is cut off go too. A document may end up empty.
    """
    done = passages.remove_repeats(docs, PASSAGE_WORDS, kept_col="_kept", words=True)
    changed = F.col("_kept.n_removed") > 0
    text = F.when(changed, passages.whole_characters("_kept.kept")).otherwise(F.col("text"))
    done = done.withColumn("text", text)
    return done.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


@plainly
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, dealt to sources by weight; a document comes once per epoch that takes it."""
    chosen = mixing.mix(docs, source_domain(), mixing.word_tokens(F.col("text")), mixture_weights(), fraction=0.9, max_epochs=2)
    return chosen.select(*docs.columns)


@plainly
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of the bytes they decode to."""
    done = docs.withColumn("_t", bpe.round_tripper(spark, RANKS, public_tokenizers.PATTERN)("text")).drop("text")
    return done.withColumns({
        "ids": F.col("_t.ids"), "n_tokens": F.size("_t.ids").cast("long"), "ids_sha256": bpe.ids_digest(F.col("_t.ids")),
        "decoded_sha256": F.sha2("_t.decoded", 256),
    }).drop("_t")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]
# A trained classifier and repeated strings are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is a table of its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
