"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds documents in blocks of similar size. A document's signature is
a Bloom filter of its terms; a block stores one bitmap over its documents for
every bit of the filter (a slice), so the documents that may hold a term are
the AND of a few slices. A term that occurs often is entered once more for each
threshold in ``TIMES`` that its occurrences reach, so the slices also bound how
often it occurs. Such bitmaps never miss a document, they only add some.

A term contributes ``weight * f`` to a score, and f grows with the occurrences.
The bound of a document is the sum over a query's terms of the weight times the
f of the largest number of occurrences its slices allow. Each query

1. takes the documents of the highest bounds and scores them exactly, which
   gives a score that its k-th best document reaches at least;
2. scores exactly every other document whose bound reaches that score.

Documents left out are proven to score lower. Queries are dealt with in blocks,
which all tasks hold; documents, signatures and candidates stay distributed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redgreen.llm.support import discard, durable, pick, reread, ship

# Slices that are set for an entry, and slices per entry of a signature at the least.
SLICES, SPACE = 3, 12
# Occurrences from which a term has another entry.
TIMES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
# Documents of a block, and bits: a block's size in memory.
BLOCK_ROWS, BLOCK_BITS = 1024, 1 << 23
# Queries that meet the signatures at once, and terms whose documents one pass counts: bounds of memory.
QUERY_BLOCK, TERM_BLOCK = 256, 200_000
# Candidate documents up to this number are sent to the tasks that read texts; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
# A term's occurrences weigh WEIGHT * tf / (1000 * tf + 8 * m).
WEIGHT = 1_000_000_000

# ASCII but for digits and letters ends a term, A-Z are lower-cased.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c > 0x7F else 0x20 for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """Terms ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a text, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def occurrence_weight(tf: int, m: int) -> int:
    return WEIGHT * tf // (1000 * tf + 8 * m)


def length_factor(n: int, documents: int, total: int) -> int:
    """How a document's length damps its terms: 100 at the mean length."""
    return 10 + 90 * n * documents // total


def term_weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Memory:
    """64-bit hashes of terms, emptied when it holds many."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, terms: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 100_000:
            known.clear()
        for term in terms:
            if term not in known:
                known[term] = xxhash.xxh3_64_intdigest(term)
        return np.fromiter(map(known.__getitem__, terms), dtype=np.uint64, count=len(terms))


def slice_numbers(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    """``(SLICES, n)`` numbers of the slices of some terms' entries of one level, below ``2^bits``."""
    x = (hashes ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    step = (x >> np.uint64(32)) | np.uint64(1)
    mask = np.uint64((1 << bits) - 1)
    return np.stack([(x + np.uint64(i) * step) & mask for i in range(SLICES)]).astype(np.int64)


def block_of(entries: list[tuple[np.ndarray, np.ndarray]], bits: int) -> bytes:
    """The slices of a block, one after the other; ``entries`` has hashes and occurrences of each document's terms."""
    width = -(-len(entries) // 8) * 8
    filled = np.zeros((1 << bits, width), dtype=bool)
    for place, (hashes, times) in enumerate(entries):
        for level, least in enumerate(TIMES):
            some = hashes[times >= least]
            if not len(some):
                break
            filled[slice_numbers(some, level, bits).ravel(), place] = True
    return np.packbits(filled, axis=1, bitorder="little").tobytes()


def index(documents: DataFrame) -> DataFrame:
    """Signatures of ``(key, text)``: rows ``(bits, keys, n, top, slices)``, one for a block of documents.

    ``n`` counts a document's terms, ``top`` the most frequent one's
    occurrences. A block holds documents whose filters have ``2^bits`` slices
    each. Documents without terms are in no block.
    """
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from redgreen.llm import lexical as m

        held: dict[int, list] = {}
        memory = m.Memory()

        def block(bits: int) -> pa.RecordBatch:
            rows = held.pop(bits)
            longs = [pa.array([[r[i] for r in rows]], pa.list_(pa.int64())) for i in range(3)]
            return pa.RecordBatch.from_arrays(
                [pa.array([bits], pa.int32()), *longs, pa.array([m.block_of([r[3] for r in rows], bits)], pa.binary())],
                ["bits", "keys", "n", "top", "slices"],
            )

        for batch in batches:
            for key, text in zip(*batch.columns):
                counted = Counter(m.terms_of(text.as_py()))
                if not counted:
                    continue
                times = np.fromiter(counted.values(), dtype=np.int64, count=len(counted))
                entries = sum(int((times >= least).sum()) for least in m.TIMES)
                bits = max(8, (entries * m.SPACE - 1).bit_length())
                held.setdefault(bits, []).append((key.as_py(), int(times.sum()), int(times.max()), (memory.of(list(counted)), times)))
                if len(held[bits]) >= max(8, min(m.BLOCK_ROWS, m.BLOCK_BITS >> bits)):
                    yield block(bits)
        for bits in list(held):
            yield block(bits)

    return documents.mapInArrow(run, "bits int, keys array<bigint>, n array<bigint>, top array<bigint>, slices binary")


class Queries:
    """A block of queries: their terms' hashes and a row of term weights for each query."""

    def __init__(self, queries: list[list[bytes]], weights: dict[bytes, int], documents: int, total: int):
        terms = sorted({t for q in queries for t in q if weights.get(t, 0) > 0})
        place = {t: i for i, t in enumerate(terms)}
        self.hashes = Memory().of(terms)
        self.weights = np.zeros((len(queries), len(terms)))
        for i, query in enumerate(queries):
            for t in query:
                if t in place:
                    self.weights[i, place[t]] = weights[t]
        self.documents, self.total = documents, total

    def bounds(self, bits: int, n: list[int], top: list[int], slices: bytes) -> np.ndarray:
        """``(queries, documents)`` of a block: whole numbers that no score exceeds; doubles hold them exactly."""
        rows = len(n)
        lines = np.frombuffer(slices, dtype=np.uint8).reshape(1 << bits, -1)
        # How far up the levels each term may go in each document; a level counts if all below it do.
        reached = np.zeros((len(self.hashes), lines.shape[1] * 8), dtype=np.uint8)
        alive = np.arange(len(self.hashes))
        before = None
        for level in range(len(TIMES)):
            at = slice_numbers(self.hashes[alive], level, bits)
            present = reduce(np.bitwise_and, (lines[numbers] for numbers in at))
            if before is not None:
                present &= before
            some = present.any(axis=1)
            alive, before = alive[some], present[some]
            if not len(alive):
                break
            reached[alive] += np.unpackbits(before, axis=1, bitorder="little")
        used = np.flatnonzero(reached.any(axis=1))
        factors = np.zeros((len(TIMES) + 1, reached.shape[1]))
        for place in range(rows):
            m = length_factor(n[place], self.documents, self.total)
            for level in range(len(TIMES)):
                most = top[place] if level + 1 == len(TIMES) else min(top[place], TIMES[level + 1] - 1)
                factors[level + 1, place] = occurrence_weight(most, m)
        return (self.weights[:, used] @ np.take_along_axis(factors, reached[used], axis=0))[:, :rows]


def counted_terms(documents: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """In how many documents each of some terms stands; one number for each term comes back."""
    shared = documents.sparkSession.sparkContext.broadcast(frozenset(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from redgreen.llm import lexical as m

        wanted, found = shared.value, Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(wanted.intersection(m.terms_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

    sums = documents.select("text").mapInArrow(run, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r["term"]): r["n"] for r in sums.collect()}


def candidates(blocks: DataFrame, queries: Queries, k: int, least: list[int] | None = None) -> DataFrame:
    """``(query, key, bound)``: with ``least`` all documents whose bound reaches it, otherwise each task's ``k`` highest."""
    shared = blocks.sparkSession.sparkContext.broadcast((queries, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, least = shared.value
        names = ["query", "key", "bound"]
        best = [(np.empty(0, dtype=np.int64), np.empty(0))] * len(queries.weights)
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.array(row["keys"], dtype=np.int64)
                bounds = queries.bounds(row["bits"], row["n"], row["top"], row["slices"])
                if least is not None:
                    query, place = np.nonzero(bounds >= np.maximum(np.array(least, dtype=float), 1)[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(keys[place]), pa.array(bounds[query, place])], names)
                    continue
                for i, line in enumerate(bounds):
                    places = np.argpartition(-line, min(k, len(line)) - 1)[:k]
                    places = places[line[places] > 0]
                    seen, bound = np.concatenate([best[i][0], keys[places]]), np.concatenate([best[i][1], line[places]])
                    first = np.argsort(-bound, kind="stable")[:k]
                    best[i] = seen[first], bound[first]
        if least is None:
            query = np.repeat(np.arange(len(best)), [len(b) for _, b in best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(query, pa.int32()), pa.array(np.concatenate([s for s, _ in best])), pa.array(np.concatenate([b for _, b in best]))], names
            )

    found = blocks.mapInArrow(run, "query int, key bigint, bound double")
    if least is not None:
        return found
    ranked = Window.partitionBy("query").orderBy(F.desc("bound"), "key")
    return found.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k).drop("place")


def scored(documents: DataFrame, found: DataFrame, queries: list[list[bytes]], weights: dict[bytes, int], count: int, total: int) -> DataFrame:
    """``(query, doc_id, score)``: exact scores above 0 of the pairs ``found``, counted on whole texts."""
    shared = documents.sparkSession.sparkContext.broadcast((queries, weights))
    # One document has as many queries as a block at the most.
    wanted = durable(found.groupBy("key").agg(F.collect_set("query").alias("queries")), "wanted")
    met = documents.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "key").select("doc_id", "text", "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from redgreen.llm import lexical as m

        queries, weights = shared.value
        for batch in batches:
            number, places, scores = [], [], []
            for place, (text, asked) in enumerate(zip(batch.column(1), batch.column(2))):
                tf = Counter(m.terms_of(text.as_py()))
                damp = m.length_factor(tf.total(), count, total)
                part = {t: weights[t] * m.occurrence_weight(tf[t], damp) for t in weights.keys() & tf.keys()}
                for query in asked.as_py():
                    score = sum(part.get(t, 0) for t in queries[query])
                    if score > 0:
                        number.append(query)
                        places.append(place)
                        scores.append(score)
            ids = batch.column(0).take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), ids, pa.array(scores, pa.int64())], ["query", "doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return met.mapInArrow(run, f"query int, doc_id {kind}, score bigint")


def search(
    documents: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents of the highest scores above 0 of every item.

    With N documents that hold a term and L terms in all of them, a document of
    n terms has ``m = 10 + 90 n N div L`` and scores the sum, over the item's
    distinct terms, of ``floor(1000 ln((2N + 2) / (2 df + 1)))`` times
    ``10^9 tf div (1000 tf + 8 m)``. Equal scores go by ascending id, no id
    last. All counts cover all documents.

    Null texts and those without terms hold nothing and find nothing. Rows that
    repeat an id, equal or not, are documents each, and items each. Empty
    tables give no rows.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = pick(documents, doc_id=id_col, text=text_col)
    # Names a row by its content: rows that share a key, equal or by chance, are scored together, and each by its own text.
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    blocks = durable(index(docs.select("key", "text")), "signatures")
    sums = blocks.agg(F.sum(F.size("keys")).alias("n"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b)).alias("total")).first()
    asked = durable(pick(items, item_id=item_col, text=item_text_col).withColumn("number", F.monotonically_increasing_id()), "items")
    numbers = [r["number"] for r in asked.select("number").orderBy("number").collect()]  # a number for each query
    kind = items.schema[item_col].dataType.simpleString()
    parts = [spark.createDataFrame([], f"number bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint")]
    count, total = sums["n"] or 0, sums["total"] or 0
    tables = []
    for start in range(0, len(numbers) if total else 0, QUERY_BLOCK):
        own = numbers[start : start + QUERY_BLOCK]
        rows = asked.where(F.col("number").between(own[0], own[-1])).orderBy("number").collect()
        queries = [sorted(set(terms_of(r["text"]))) for r in rows]
        terms = sorted({t for q in queries for t in q})
        df: dict[bytes, int] = {}
        for at in range(0, len(terms), TERM_BLOCK):
            df |= counted_terms(docs, terms[at : at + TERM_BLOCK])
        weights = {t: term_weight(n, count) for t, n in df.items()}
        block = Queries(queries, weights, count, total)
        facts = (queries, weights, count, total)
        first = scored(docs, candidates(reread(blocks), block, k), *facts).groupBy("query").agg(F.sort_array(F.collect_list("score"), False).alias("s"))
        least = [0] * len(queries)
        for r in first.collect():  # some k scores of each query of the block
            least[r["query"]] = r["s"][k - 1] if len(r["s"]) >= k else 0
        found = durable(candidates(reread(blocks), block, k, least), "candidates")
        ranked = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        exact = scored(docs, found, *facts).withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k)
        places = spark.createDataFrame(list(enumerate(own)), "query int, number bigint")
        parts.append(durable(exact.join(F.broadcast(places), "query").select("number", "doc_id", "score"), "found"))
        tables.append(found)
    discard([blocks, *tables])
    answers = reduce(DataFrame.union, parts).join(asked.select("number", F.col("item_id").cast(kind).alias("item_id")), "number")
    ranked = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return answers.withColumn("rank", F.row_number().over(ranked)).select("item_id", "rank", "doc_id", "score")
