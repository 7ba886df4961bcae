"""Centroid clustering of integer vectors, with distances from packed bit planes.

A vector has 64 integer components, so bit j of all of them fits one unsigned
64-bit word: plane j. In two's complement plane j weighs ``2^j``, the highest
one ``-2^j``, and with planes X of a vector and C of a centroid

    x . c = sum over j, k of weight_j * weight_k * popcount(X_j & C_k)

is exact, as are ``|x|^2`` (the same with itself) and the squared distance
``|x|^2 + |c|^2 - 2 x . c``. Sums of vectors are counted plane by plane too.

The planes are written once. A round reads them, assigns every vector and sends
one row of sums per centroid and task; new centroids are made from one row per
centroid. No vector moves between tasks in any round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redgreen.llm.support import discard, durable, pick, reread, ship

COMPONENTS = 64
# Components from this magnitude on would leave no room for a squared distance in a long.
LIMIT = 1 << 27
# Vectors compared with all centroids at once: a bound of memory.
CHUNK = 4096


def planes_of(values: np.ndarray, bits: int) -> np.ndarray:
    """``(n, bits)`` words of ``(n, 64)`` integers; component i is bit i of a word."""
    shifts = np.arange(bits, dtype=np.int64)
    set_ = ((values[:, None, :] >> shifts[None, :, None]) & 1).astype(np.uint8)
    return np.packbits(set_, axis=2, bitorder="little").view(np.uint64).reshape(len(values), bits)


def plane_weights(bits: int) -> np.ndarray:
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)
    weights[-1] = -weights[-1]
    return weights


def products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``(n, k)`` dot products of the vectors behind two tables of planes, as weighted popcounts of ANDs."""
    weights = plane_weights(x.shape[1])
    out = np.zeros((len(x), len(c)), dtype=np.int64)
    for j, one in enumerate(weights):
        for k, other in enumerate(weights):
            common = np.bitwise_count(x[:, j, None] & c[None, :, k])
            out += common * (one * other)
    return out


def squares(x: np.ndarray) -> np.ndarray:
    """``(n,)`` squared lengths."""
    weights = plane_weights(x.shape[1])
    out = np.zeros(len(x), dtype=np.int64)
    for j, one in enumerate(weights):
        for k, other in enumerate(weights):
            out += np.bitwise_count(x[:, j] & x[:, k]) * (one * other)
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller of equally near ones, and the squared distance to it."""
    lengths = squares(c)
    cluster, distance = np.empty(len(x), dtype=np.int32), np.empty(len(x), dtype=np.int64)
    for at in range(0, len(x), CHUNK):
        part = x[at : at + CHUNK]
        far = squares(part)[:, None] + lengths[None, :] - 2 * products(part, c)
        cluster[at : at + CHUNK] = far.argmin(axis=1)  # the first of equal ones
        distance[at : at + CHUNK] = far.min(axis=1)
    return cluster, distance


def component_sums(x: np.ndarray) -> np.ndarray:
    """``(64,)`` sums of the vectors behind some planes."""
    out = np.zeros(COMPONENTS, dtype=np.int64)
    for at in range(0, len(x), CHUNK):
        part = np.ascontiguousarray(x[at : at + CHUNK])
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), x.shape[1], 8), axis=2, bitorder="little")
        out += plane_weights(x.shape[1]) @ bits.sum(axis=0, dtype=np.int64)
    return out


def _matrix(column: pa.Array, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in column), dtype=np.uint64).reshape(len(column), bits)


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``(vec_id, v)``: vectors of 64 components, each component x as floor(scale * x) in a long.

    Null vectors, vectors of another length and those that hold a null or
    non-finite component are left out, and so are those with a component whose
    integer lies beyond 2^27 either way, whose distances no long could hold.
    Rows without an id are kept.
    """
    rows = pick(df, vec_id=id_col, raw=vector_col)
    fits = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < float(LIMIT)))
    rows = rows.where(F.col("raw").isNotNull() & (F.size("raw") == COMPONENTS) & F.coalesce(fits, F.lit(False)))
    return rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("raw", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v")
    )


def pack(vectors: DataFrame, bits: int) -> DataFrame:
    """``(vec_id, planes)`` of ``(vec_id, v)``: ``bits`` words of 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from redgreen.llm import centroids as m

        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, m.COMPONENTS)
            words = m.planes_of(values, bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w.tobytes() for w in words], pa.binary())], ["vec_id", "planes"])

    return vectors.mapInArrow(run, "vec_id bigint, planes binary")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors whose ids hash smallest, in the order of the hashes; rows without an id are never among them."""
    ranked = vectors.where("vec_id is not null").withColumn("rank", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    rows = ranked.orderBy("rank", "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], dtype=np.int64).reshape(-1, COMPONENTS)


def moved(planes: DataFrame, centroids: np.ndarray, bits: int) -> np.ndarray:
    """Centroids after one round; one without vectors stays."""
    shared = planes.sparkSession.sparkContext.broadcast(planes_of(centroids, bits))  # k rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from redgreen.llm import centroids as m

        c = shared.value
        counts, sums = np.zeros(len(c), dtype=np.int64), np.zeros((len(c), m.COMPONENTS), dtype=np.int64)
        for batch in batches:
            x = m._matrix(batch.column(0), bits)
            cluster, _ = m.nearest(x, c)
            counts += np.bincount(cluster, minlength=len(c))
            for i in np.unique(cluster):
                sums[i] += m.component_sums(x[cluster == i])
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["cluster", "n", "sums"]
        )

    parts = planes.select("planes").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(COMPONENTS)]).alias("sums"))
    out = centroids.copy()
    for row in added.collect():  # one row per centroid
        out[row["cluster"]] = [s // row["n"] for s in row["sums"]]  # whole numbers, rounded down
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid)`` of every row.

    ``vectors`` is ``(vec_id, v)`` of ``integer_vectors``. ``rounds`` times all
    vectors go to the nearest centroid (ties: the smaller number) and centroids
    move to the rounded-down mean; then vectors are assigned once more. With
    fewer than ``k`` ids there are fewer centroids. Rows that repeat an id are
    vectors of their own, and equal ones among the first make equal centroids,
    of which the larger number stays empty; rows without an id are clustered. A table without ids
    gives no rows. How many planes there are follows from the largest component.
    """
    spark = vectors.sparkSession
    ship(spark)
    table = durable(vectors, "vectors")
    centroids = first_centroids(table, k, seed)
    ends = table.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    if not len(centroids):
        bits = 1
        table = table.limit(0)
    else:
        bits = max(int(ends["high"]).bit_length(), int(-ends["low"] - 1).bit_length() if ends["low"] < 0 else 0) + 1
    planes = durable(pack(table, bits), "planes")
    if len(centroids):
        discard([table])
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(planes, centroids, bits)
    shared = spark.sparkContext.broadcast(planes_of(centroids, bits))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from redgreen.llm import centroids as m

        for batch in batches:
            number, distance = m.nearest(m._matrix(batch.column(1), bits), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = durable(planes.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint"), "assigned")
    sums = {r["cluster"]: r["s"] for r in reread(assigned).groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row per centroid
    facts = [
        (i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest(), c.tolist())
        for i, c in enumerate(centroids)
    ]
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>"
    return assigned.join(F.broadcast(spark.createDataFrame(facts, schema)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"
    )
