"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

A text's words give four kinds of n-grams: words and word pairs, and shapes
and shape pairs (letters folded to their case, digits to 0, other characters
kept, repeats shortened; a word that equals the one before it has the shape of
a repeat). They are hashed into a fixed number of slots; a slot's value is the
square root of its share among the text's n-grams, so a text of any length has
a vector of length one. Training follows the regularised leader
(FTRL-proximal) over a bounded, seeded sample of labelled rows. Scores are
sparse dot products.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redgreen.llm.support import durable, pick, ship, tidy

SLOT_BITS = 18
# At most this many labelled rows are learned from: those with the smallest hashes of their ids.
TRAINING_ROWS = 8_000
EPOCHS = 5

_SHAPE = str.maketrans({**{c: "0" for c in "0123456789"}, "\n": "n", "\r": "n", "\t": "t"})
_RUN = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Upper letters to A, lower to a, digits to 0, runs to two."""
    folded = "".join("A" if c.isupper() else "a" if c.isalpha() else c for c in word)
    return _RUN.sub(r"\1\1", folded.translate(_SHAPE))


class Features:
    """Slots and values of texts; remembers the hashes of words."""

    def __init__(self, bits: int = SLOT_BITS):
        self.shift = np.uint64(64 - bits)
        self.memory: dict[str, tuple[int, int]] = {}

    def hashes(self, words: list[str]) -> np.ndarray:
        memory = self.memory
        if len(memory) > 100_000:
            memory.clear()
        for word in set(words):
            if word not in memory:
                lowered = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
                memory[word] = (lowered, xxhash.xxh3_64_intdigest(shape(word).encode("utf-8", "surrogatepass"), seed=1))
        return np.array([memory[word] for word in words], dtype=np.uint64).reshape(-1, 2)

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct slots and their values; a text without words has none."""
        # Cut at blanks; line ends stay with their word, whose shape shows them.
        words = [w for w in (text or "").split(" ") if w]
        if not words:
            return np.empty(0, dtype=np.int64), np.empty(0)
        both = self.hashes(words)
        word, form = both[:, 0], both[:, 1].copy()
        form[1:][word[1:] == word[:-1]] = np.uint64(0x5E9EA7)  # the shape of a repeat
        grams = [word, form]
        for line, salt in ((word, 3), (form, 5)):
            grams.append((line[:-1] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) ^ (line[1:] * np.uint64(0xC2B2AE3D27D4EB4F)))
        mixed = np.concatenate(grams) * np.uint64(0xD6E8FEB86659FD93)
        slots, counts = np.unique((mixed >> self.shift).astype(np.int64), return_counts=True)
        return slots, np.sqrt(counts / len(mixed))


class Ftrl:
    """FTRL-proximal logistic regression over sparse rows."""

    def __init__(self, slots: int, alpha: float = 2.0, beta: float = 0.1, l1: float = 0.002, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(slots + 1), np.zeros(slots + 1)  # the last slot is the bias

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.append(slots, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        gradient = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        sigma = (np.sqrt(self.n[at] + gradient**2) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += gradient - sigma * w
        self.n[at] += gradient**2


def train(labelled: DataFrame, rows: int = TRAINING_ROWS, seed: int = 7) -> np.ndarray:
    """Weights, bias last, from ``(doc_id, text, label)`` with labels 0 and 1.

    Texts become sparse rows where they are read. At most ``rows`` of them are
    learned from, by one task, as the updates follow each other; that bound and
    the number of slots hold at any size of input. Without rows all weights are
    zero and every score is one half.
    """
    ship(labelled.sparkSession)

    @tidy
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from redgreen.llm import quality as q

        features = q.Features()
        for batch in batches:
            both = [features.of(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([x.astype(np.int32).tobytes() for x, _ in both], pa.binary()),
                 pa.array([v.astype(np.float32).tobytes() for _, v in both], pa.binary())],
                ["doc_id", "label", "slots", "numbers"],
            )

    clean = labelled.where("label in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("label").cast("int").alias("label"))
    sample = clean.mapInArrow(vectors, "doc_id bigint, label int, slots binary, numbers binary")
    sample = sample.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "slots", "label").limit(rows).withColumn("all", F.lit(0))

    def learn(part: pa.Table) -> pa.Table:
        from redgreen.llm import quality as q

        model = q.Ftrl(1 << q.SLOT_BITS)
        rows = sorted(zip(*(part.column(c).to_pylist() for c in ("doc_id", "label", "slots", "numbers"))))
        lines = [(np.frombuffer(s, dtype=np.int32), np.frombuffer(v, dtype=np.float32), label) for _, label, s, v in rows]
        order = np.random.default_rng(seed)
        for _ in range(q.EPOCHS):
            for i in order.permutation(len(lines)):
                model.learn(*lines[i])
        return pa.table({"weights": pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())})

    learned = sample.groupBy("all").applyInArrow(learn, "weights binary").collect()  # one row
    if not learned:
        return np.zeros((1 << SLOT_BITS) + 1, dtype=np.float32)
    return np.frombuffer(learned[0]["weights"], dtype=np.float32)


def scorer(df: DataFrame, weights: np.ndarray):
    """Column function: text to its score between 0 and 1. A null or empty text has the score of the bias."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(weights)  # one float per slot

    @F.arrow_udf("double")
    @tidy
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from redgreen.llm import quality as q

        features, w = q.Features(), shared.value.astype(np.float64)
        for batch in batches:
            out = np.empty(len(batch))
            for i, text in enumerate(batch):
                slots, values = features.of(text.as_py())
                out[i] = w[slots] @ values + w[-1]
            yield pa.array(1 / (1 + np.exp(-np.clip(out, -500, 500))), pa.float64())

    return score


def held_out(id_col: str = "doc_id", divisor: int = 5) -> Column:
    """Whether a row's labels must not be learned from; a null id never is learned from, nor held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> np.ndarray:
    """Weights learned from ``labels.quality`` of at most ``rows`` documents that are not held out.

    A document labelled twice counts with its smaller label, equal rows count
    once, and rows that share an id and differ in text each. Null ids, null labels and labels but 0 and 1 take no part.
    """
    marks = pick(labels, doc_id="doc_id", quality="quality").where("doc_id is not null and quality in (0, 1)")
    few = marks.where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = durable(few.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(rows), "labels")
    docs = pick(documents, doc_id="doc_id", text="text").join(F.broadcast(few), "doc_id")  # ``rows`` ids at most
    # A row that is repeated, however often, is learned from once and leaves room for the others.
    once = docs.select("doc_id", "text", F.col("quality").cast("int").alias("label")).dropDuplicates(["doc_id", "text"])
    return train(once, rows)


def score_documents(documents: DataFrame, weights: np.ndarray, least: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row; predicted 1 from ``least`` on."""
    rows = pick(documents, doc_id="doc_id", text="text")
    scored = rows.select("doc_id", held_out().alias("held_out"), scorer(documents, weights)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))


def keep_good(documents: DataFrame, weights: np.ndarray, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores ``least`` or more."""
    return documents.where(scorer(documents, weights)(F.col(f"`{text_col}`")) >= least)
