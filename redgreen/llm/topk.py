"""Exact top-k search by inner product, with pivot-table elimination.

Every vector's Euclidean distances to many pivots are computed once. For a
query q and a candidate x the triangle inequality gives
``d(q, x) >= max over pivots |d(q, p) - d(x, p)|``, and since
``q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2``, an upper bound of the score.
Candidates are evaluated from the highest bound down, until no bound is left
that reaches the k-th best score found.

Candidates are dealt into shards around their nearest pivots, and a shard is
bounded as a whole by how far its rows lie from those pivots. A query first
meets its own shard, which gives a score that its k-th best row reaches at
least, and then only the shards whose bound reaches that score. A task holds one
block of queries and one shard, both bounded, whatever the table's size.

How much is left out depends on the data. Bounds are sharp where vectors lie
near pivots, as in clusters; vectors that are all about equally far from each
other are bounded by nothing but their lengths, and all of them are evaluated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from redgreen.llm.support import durable, pick, reread, ship

# Vectors among which pivots are chosen: a bound of the sample, not of the search.
PIVOT_SAMPLE = 4096
# Pairs of a query and a row whose bounds are held at once: a bound of memory.
PAIRS = 1 << 20
RESULT = "dim int, query_id bigint, vec_id bigint, score bigint, evaluated bigint, met bigint"
# Below every score: a query that has found less than k rows.
NONE = -(1 << 62)


def scaled_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """``(vec_id, v, dim)``: each component x as floor(scale * x) in a long.

    Rows whose id or vector is null, or whose vector holds a null or non-finite
    component, are left out. ``dim`` is the number of components.
    """
    rows = pick(df, vec_id=id_col, raw=vector_col)
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("raw").isNotNull() & finite)
    return rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("raw", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"),
        F.size("raw").alias("dim"),
    )


def choose_pivots(vectors: DataFrame, pivots: int) -> dict[int, np.ndarray]:
    """Pivots by dimension: of a bounded, seeded sample, each the farthest from those before it."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("v", "dim").collect()
    chosen = {}
    for dim in {row["dim"] for row in sample}:
        points = np.array([row["v"] for row in sample if row["dim"] == dim], dtype=np.float64).reshape(-1, dim)
        places = [0]
        nearest = ((points - points[0]) ** 2).sum(axis=1)
        while len(places) < min(pivots, len(points)) and nearest.max() > 0:
            places.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, ((points - points[places[-1]]) ** 2).sum(axis=1))
        chosen[dim] = points[places]
    return chosen


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of points to pivots, one row per pivot."""
    squares = (points**2).sum(axis=1)[None, :] + (pivots**2).sum(axis=1)[:, None] - 2 * (pivots @ points.T)
    return np.sqrt(np.maximum(squares, 0))


def score_bounds(q: np.ndarray, q_table: np.ndarray, x: np.ndarray, x_table: np.ndarray) -> np.ndarray:
    """``(queries, rows)``: no score exceeds them. Tables hold distances, one row per pivot."""
    gap = np.zeros((q_table.shape[1], x_table.shape[1]), dtype=np.float32)
    part = np.empty_like(gap)
    for one, other in zip(q_table.astype(np.float32), x_table.astype(np.float32)):
        np.subtract(one[:, None], other[None, :], out=part)
        np.abs(part, out=part)
        np.maximum(gap, part, out=gap)
    # Rounding of roots, squares and narrow numbers must never lower a bound.
    farthest = max(q_table.max(initial=0), x_table.max(initial=0))
    least = np.maximum(gap.astype(np.float64) - 1e-6 * farthest, 0)
    lengths = (q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :]
    return (lengths - least**2) / 2 + 1e-6 * lengths + 1e-6


def search_block(
    queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], pivots: np.ndarray, k: int,
    least: np.ndarray | None = None, step: int = 256,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each query of a block its best ``k`` among the rows: ``(places, row ids, scores, evaluated)``.

    A query never finds the rows of its own id, nor scores below ``least`` if
    that is given. Scores are exact: products of longs are summed in doubles
    only while every sum stays below 2^53. ``evaluated`` counts the pairs whose
    score was needed.
    """
    query_ids, q = queries
    row_ids, x = rows
    if not len(row_ids) or not len(query_ids):
        return
    order = np.argsort(row_ids, kind="stable")
    row_ids, x = row_ids[order], x[order]
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    kind = np.float64 if largest < 2.0**53 else np.int64
    exact_q, exact_x = q.astype(kind), x.astype(kind)
    real_q, real_x = q.astype(np.float64), x.astype(np.float64)
    x_table, q_table = distances(real_x, pivots), distances(real_q, pivots)
    size = max(1, PAIRS // len(row_ids))
    for at in range(0, len(query_ids), size):
        some = slice(at, at + size)
        bound = score_bounds(real_q[some], q_table[:, some], real_x, x_table)
        bound[query_ids[some, None] == row_ids[None, :]] = -np.inf
        n = min(step, len(row_ids))
        first = np.argpartition(-bound, n - 1, axis=1)[:, :n]
        scores = np.einsum("qd,qnd->qn", exact_q[some], exact_x[first])
        scores = np.where(np.take_along_axis(bound, first, axis=1) == -np.inf, np.array(NONE, dtype=kind), scores)
        reach = np.partition(scores, n - k, axis=1)[:, n - k] if n >= k else np.full(len(scores), NONE, dtype=kind)
        if least is not None:
            reach = np.maximum(reach, least[some].astype(kind))
        open_ = bound >= reach[:, None]  # the others are proven to be no better
        evaluated = int(open_.sum())
        dense = evaluated * 4 > open_.size
        whole = exact_q[some] @ exact_x.T if dense else None
        for i in range(len(open_)):
            places = np.flatnonzero(open_[i])
            found = whole[i, places] if dense else exact_x[places] @ exact_q[at + i]
            keep = found >= reach[i]
            places, found = places[keep], found[keep]
            best = np.lexsort((row_ids[places], -found))[:k]
            yield np.full(len(best), at + i), row_ids[places[best]], found[best].astype(np.int64), evaluated if i == 0 else 0


def in_cells(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` with the number of the nearest pivot and the distance to it."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from redgreen.llm.topk import distances

        for batch in batches:
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            cell, away = np.zeros(len(dims), dtype=np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                points = batch.column(1).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), dim)
                table = distances(points.astype(np.float64), shared.value.get(int(dim), np.zeros((1, dim))))
                cell[own], away[own] = table.argmin(axis=0), table.min(axis=0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], ["vec_id", "v", "dim", "cell", "away"])

    return vectors.select("vec_id", "v", "dim").mapInArrow(run, "vec_id bigint, v array<bigint>, dim int, cell int, away double")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, pivots: int = 256, query_block: int = 4096, shard_rows: int = 16384) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows of every query row.

    ``vectors`` is ``(vec_id, v, dim)``. Scores are integer inner products;
    ties go to the smaller ``vec_id``. Rows that repeat an id are candidates
    each, but a query never finds its own id, and a repeated query id answers
    once per distinct vector, ranked together. Vectors are compared with those of their own
    length. Fewer than ``k`` candidates are all returned; an empty table gives
    no rows. ``search`` gives the same before ranking, and what it evaluated.

    Only ``k`` rows per query and shard come out, and a map-side rank limit
    precedes the final window.
    """
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = search(vectors, is_query, k, pivots, query_block, shard_rows).where("vec_id is not null")
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def search(vectors: DataFrame, is_query: Column, k: int, pivots: int = 256, query_block: int = 4096, shard_rows: int = 16384) -> DataFrame:
    """``RESULT`` rows: what each query found in each shard it met.

    Rows without ``vec_id`` carry a block's numbers of pairs ``met`` in a
    shard and ``evaluated``; the others have 0 there.
    """
    spark = vectors.sparkSession
    ship(spark)
    table = durable(vectors, "vectors")
    points = choose_pivots(table, pivots)
    cells = durable(in_cells(table, points), "cells")
    square = F.aggregate("v", F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double"))
    stats = cells.groupBy("dim", "cell").agg(
        F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high"), F.max(square).alias("square")
    )
    facts = sorted(tuple(r) for r in stats.collect())  # a row for each pivot
    plan = shards_of(facts, shard_rows)
    homes = spark.createDataFrame(plan or [(0, 0, 0, 0)], "dim int, cell int, base int, parts int")
    # Rows of a cell beyond a shard's size spread by id and a running number, so that neither copies nor a repeated id meet in one.
    part = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("parts")).cast("int")
    placed = reread(cells).join(F.broadcast(homes), ["dim", "cell"]).withColumn("shard", F.col("base") + part)
    dealt = durable(placed.select("shard", "dim", "vec_id", "v"), "shards")  # a running number is not repeatable
    queries = durable(placed.where(is_query).dropDuplicates(["vec_id", "v"]).select("shard", "dim", "vec_id", "v"), "queries")
    blocks = max(1, math.ceil(queries.count() / query_block))
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block")
    first = _meet(queries.select(block, "shard", "dim", "vec_id", "v", F.lit(NONE).alias("least")), dealt, points, k, blocks)
    first = durable(first, "found")
    # The k-th score that a query has found bounds from below what can still come in.
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"))
    own = first.where("vec_id is not null").withColumn("place", F.row_number().over(ranked)).where(F.col("place") == k)
    least = own.select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    asked = reread(queries).join(least, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(NONE)))
    others = _reached(asked, facts, plan, points).select(block, "shard", "dim", "vec_id", "v", "least")
    return first.union(_meet(others, reread(dealt), points, k, blocks))


def shards_of(facts: list[tuple], shard_rows: int) -> list[tuple[int, int, int, int]]:
    """``(dim, cell, first shard, shards)``: neighbouring cells share a shard while they fit, a large one has several."""
    plan, shard, filled, last = [], -1, 0, None
    for dim, cell, n, *_ in facts:
        parts = math.ceil(n / shard_rows)
        if parts > 1 or dim != last or filled + n > shard_rows or shard < 0:
            shard += 1
            filled = 0
        plan.append((dim, cell, shard, parts))
        shard += parts - 1
        filled = shard_rows if parts > 1 else filled + n
        last = dim
    return plan


def _reached(asked: DataFrame, facts: list[tuple], plan: list[tuple], points: dict[int, np.ndarray]) -> DataFrame:
    """``asked`` for every shard but their own whose bound reaches ``least``."""
    cells: dict[int, tuple[np.ndarray, ...]] = {}
    for dim in {f[0] for f in facts}:
        own = [(f[1], f[3], f[4], f[5], p[2], p[3]) for f, p in zip(facts, plan) if f[0] == dim]
        cells[dim] = tuple(np.array(c) for c in zip(*own))
    shared = asked.sparkSession.sparkContext.broadcast((cells, points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from redgreen.llm.topk import distances

        cells, points = shared.value
        for batch in batches:
            shards = []
            for own, dim, v, least in zip(*(batch.column(c).to_pylist() for c in ("shard", "dim", "v", "least"))):
                cell, low, high, square, base, parts = cells[dim]
                q = np.array([v], dtype=np.float64).reshape(1, dim)
                away = distances(q, points.get(dim, np.zeros((1, dim))))[cell, 0]
                gap = np.maximum(np.maximum(away - high, low - away) - 1e-6 * (away + high), 0)
                bound = ((q**2).sum() + square) * (1 + 2e-6) / 2 - gap**2 / 2 + 1e-6
                open_ = bound >= least
                reached = {int(s) for b, p in zip(base[open_], parts[open_]) for s in range(b, b + p)}
                shards.append(sorted(reached - {own}))
            names = ["dim", "vec_id", "v", "least"]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.list_(pa.int32())), *[batch.column(c) for c in names]], ["shards", *names])

    found = asked.mapInArrow(run, "shards array<int>, dim int, vec_id bigint, v array<bigint>, least bigint")
    return found.select(F.explode("shards").alias("shard"), "dim", "vec_id", "v", "least")


def _meet(queries: DataFrame, dealt: DataFrame, points: dict[int, np.ndarray], k: int, blocks: int) -> DataFrame:
    """Every block of queries with the shards they ask."""
    shared = queries.sparkSession.sparkContext.broadcast(points)

    def find(key: tuple, one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        from redgreen.llm.topk import search_block

        names = ["dim", "query_id", "vec_id", "score", "evaluated", "met"]
        if not len(one) or not len(other):
            return pd.DataFrame({n: [] for n in names})
        dim = int(key[2])

        def matrix(side: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            lines = np.array(side["v"].tolist(), dtype=np.int64).reshape(len(side), dim)
            return side["vec_id"].to_numpy(dtype=np.int64), lines

        query_ids, lines = matrix(one)
        parts = search_block((query_ids, lines), matrix(other), shared.value.get(dim, np.zeros((1, dim))), k, one["least"].to_numpy(dtype=np.int64))
        places, found, scores, evaluated = zip(*parts)
        ids = query_ids[np.concatenate(places)]
        counts = np.zeros((2, len(ids) + 1), dtype=np.int64)
        counts[:, -1] = sum(evaluated), len(one) * len(other)  # one more row, without ids
        columns = [ids, np.concatenate(found), np.concatenate(scores)]
        return pd.DataFrame(dict(zip(names, [dim, *[pd.array([*c.tolist(), None], dtype="Int64") for c in columns], *counts])))

    keys = ["block", "shard", "dim"]
    right = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "shard", "dim", "vec_id", "v")
    return queries.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(find, RESULT)
