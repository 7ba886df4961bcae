"""The operators over whole test tables, under the names of the driver's contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redgreen.llm import bpe, centroids, langid, lattice, lexical, minhash, mixing, overlap, passages, quality, simhash, topk, urls

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
# The rules of the contract.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.scaled_vectors(read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), words=2, percent=80)


def source_domain(source: str = "source") -> Column:
    """The test tables name no domains: sources are dealt to three by their number."""
    return F.concat(F.lit("d"), (F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"(\d+)$", 1).try_cast("int") % 3).cast("string"))


def mixture_weights() -> list[Column]:
    """Target weights of domains, of languages within a domain, and of sources within a language."""
    domain = F.when(F.col("domain") == "d0", 5).when(F.col("domain") == "d1", 3).when(F.col("domain") == "d2", 2).otherwise(1)
    lang = F.when(F.col("lang") == "en", 4).when(F.col("lang") == "de", 3).when(F.col("lang") == "fr", 2).otherwise(1)
    return [domain, lang, F.when(F.col("source") == "src0", 2).otherwise(1)]


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return mixing.mixture(documents, source_domain(), mixing.word_tokens(F.col("text")), mixture_weights(), fraction=0.6, max_epochs=2)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare_edits(read(spark, sf_dir, "documents"), simhash.NEAR_COPIES)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return quality.score_documents(documents, quality.fit(documents, read(spark, sf_dir, "labels")))


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_documents(read(spark, sf_dir, "documents"), PIECES, least=1)  # every training word teaches the pieces


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return langid.predict(documents, langid.fit(documents))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digest(read(spark, sf_dir, "documents"), length=400)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = centroids.integer_vectors(read(spark, sf_dir, "embeddings"))
    return centroids.cluster(vectors, k=40, rounds=5, seed=2).drop("centroid")


def op12_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.jaccard_join(read(spark, sf_dir, "documents"), words=5, percent=80)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_bpe": op2_bpe,
    "op3_urls": op3_urls,
    "op4_minhash": op4_minhash,
    "op5_mixing": op5_mixing,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_lattice": op8_lattice,
    "op9_langid": op9_langid,
    "op10_passages": op10_passages,
    "op11_centroids": op11_centroids,
    "op12_overlap": op12_overlap,
    "op13_lexical": op13_lexical,
}
