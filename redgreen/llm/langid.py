"""Language identification by string kernels.

Two texts are as alike as the character n-grams of lengths 1 to ``ORDER`` that
both contain (a blended spectrum of presences, normalised to 1 for equal
texts). A seeded, bounded sample gives landmarks; the Nyström map takes a text
to its kernel values with them, and one ridge regression per language learns
there. A text's scores are products of its sparse presence row with the
landmarks' presence matrix and the learned coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redgreen.llm.support import durable, pick, ship

ORDER = 3
SLOTS = 1 << 15
# Bounds of the labelled sample, per language, and of the landmarks among it.
ROWS_PER_LANGUAGE = 400
LANDMARKS = 128
LANGUAGES = 256
RIDGE = 1e-3
# How much surer one language must be for its share of the score to grow e-fold.
TEMPERATURE = 0.15


def present(text: str) -> np.ndarray:
    """Slots of the n-grams that occur in a lower-cased text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    seen = np.zeros(SLOTS, dtype=bool)
    rolling = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, ORDER + 1):
        if len(points) < n:
            break
        rolling = (rolling[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        rolling ^= rolling >> np.uint64(29)
        seen[(rolling & np.uint64(SLOTS - 1)).astype(np.int64)] = True
    return np.flatnonzero(seen)


def kernel(slots: np.ndarray, landmarks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Kernel values of one text with all landmarks (``landmarks`` is slots by landmarks)."""
    common = landmarks[slots].sum(axis=0, dtype=np.float32)
    return common / np.sqrt(np.maximum(1, len(slots)) * np.maximum(1, sizes))


def has_letter(text: str | None) -> bool:
    return text is not None and (any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text)))


class Model:
    """Landmarks, coefficients and languages: a few megabytes at any size of input."""

    def __init__(self, landmarks: np.ndarray, coefficients: np.ndarray, languages: list[str]):
        self.sizes = landmarks.sum(axis=0).astype(np.float32)
        self.landmarks, self.coefficients, self.languages = landmarks, coefficients, languages

    def scores(self, texts: list[str], group: int = 256) -> Iterator[tuple[str, float]]:
        """Language and score of each text, kernels in groups and one matrix product for each."""
        for start in range(0, len(texts), group):
            part = texts[start : start + group]
            rows = np.array([kernel(present(t), self.landmarks, self.sizes) for t in part])
            values = np.hstack([rows, np.ones((len(part), 1), dtype=np.float32)]) @ self.coefficients
            best = values.argmax(axis=1)
            powers = np.exp((values - values.max(axis=1, keepdims=True)) / TEMPERATURE)
            share = powers.max(axis=1) / powers.sum(axis=1)
            for i, score in zip(best, share):
                yield self.languages[i], float(score)


def held_out(id_col: str = "doc_id", divisor: int = 4, held: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor == held, F.lit(False))


def fit(documents: DataFrame, seed: int = 11) -> Model | None:
    """A model from text and non-null ``lang`` of documents that are not held out.

    At most ``ROWS_PER_LANGUAGE`` rows of each language are learned from, those
    with the smallest hashes of their ids, found by a rank that is limited
    before rows are moved. Rows without an id or a letter in their text do not
    count; without any row there is no model.
    """
    spark = documents.sparkSession
    ship(spark)
    rows = pick(documents, doc_id="doc_id", text="text", lang="lang").where(
        ~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    # Ids first; texts are read for the chosen ones only.
    few = rows.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= ROWS_PER_LANGUAGE)
    few = few.orderBy("n", "lang").limit(ROWS_PER_LANGUAGE * LANGUAGES)
    chosen = durable(few.select("doc_id", "lang").distinct(), "languages")
    # ROWS_PER_LANGUAGE * LANGUAGES ids at most.
    texts = rows.join(F.broadcast(chosen), ["doc_id", "lang"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from redgreen.llm import langid as m

        for batch in batches:
            lines = [(t, l) for t, l in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if m.has_letter(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.packbits(np.isin(np.arange(m.SLOTS), m.present(t), assume_unique=True)).tobytes() for t, _ in lines], pa.binary()), pa.array([l for _, l in lines], pa.string())],
                ["bits", "lang"],
            )

    bits = durable(texts.select("text", "lang").mapInArrow(features, "bits binary, lang string"), "presences")
    # Landmarks: as many of each language as there is room for, by a hash of the bits.
    places = Window.partitionBy("lang").orderBy(F.xxhash64("bits"), "bits")
    ranked = bits.withColumn("n", F.row_number().over(places)).orderBy("n", "lang").limit(LANDMARKS).collect()
    if not ranked:
        return None

    def unpack(lines: list[bytes]) -> np.ndarray:
        return np.unpackbits(np.frombuffer(b"".join(lines), dtype=np.uint8)).reshape(len(lines), SLOTS)

    landmarks = np.ascontiguousarray(unpack([bytes(r["bits"]) for r in ranked]).T)
    sizes = landmarks.sum(axis=0).astype(np.float32)
    shared = spark.sparkContext.broadcast(landmarks)

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from redgreen.llm import langid as m

        matrix = shared.value
        for batch in batches:
            rows = [
                m.kernel(np.flatnonzero(np.unpackbits(np.frombuffer(b.as_py(), dtype=np.uint8))), matrix, sizes).astype(np.float64).tobytes()
                for b in batch.column(0)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], ["row", "lang"])

    # The labelled sample's rows are bounded, and so are their kernel values.
    sample = bits.mapInArrow(kernels, "row binary, lang string").collect()
    languages = sorted({r["lang"] for r in sample})
    k = np.array([np.frombuffer(r["row"], dtype=np.float64) for r in sample])
    y = np.array([[1.0 if r["lang"] == l else -1.0 for l in languages] for r in sample])
    among = np.array([kernel(np.flatnonzero(landmarks[:, i]), landmarks, sizes) for i in range(landmarks.shape[1])], dtype=np.float64)
    # Ridge in the span of the landmarks (f = K a + b); rows weigh so that every language counts alike.
    weight = 1 / np.maximum(1, (y > 0).sum(axis=0))[y.argmax(axis=1)]
    weight *= len(sample) / weight.sum()
    wide = np.hstack([k, np.ones((len(k), 1))])
    penalty = np.zeros((wide.shape[1], wide.shape[1]))
    penalty[:-1, :-1] = (among + among.T) / 2 + 1e-6 * np.eye(len(among))
    left = wide.T @ (wide * weight[:, None]) + RIDGE * len(sample) * penalty + 1e-9 * np.eye(wide.shape[1])
    coefficients = np.linalg.solve(left, wide.T @ (y * weight[:, None]))
    return Model(landmarks, coefficients.astype(np.float32), languages)


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row.

    ``und`` with score 0 where the text is null or has no letter, or where
    nothing was learned.
    """
    ship(documents.sparkSession)
    rows = pick(documents, doc_id="doc_id", text="text")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from redgreen.llm import langid as m

        learned = shared.value
        for batch in batches:
            langs, scores = ["und"] * len(batch), [0.0] * len(batch)
            at = [i for i, t in enumerate(batch) if learned is not None and m.has_letter(t.as_py())]
            for start in range(0, len(at), 256):
                part = at[start : start + 256]
                for i, (lang, score) in zip(part, learned.scores([batch[j].as_py() for j in part])):
                    langs[i], scores[i] = lang, score
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return rows.select("doc_id", held_out().alias("held_out"), run("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
