"""Exact top-k against a full sort."""

import math

import numpy as np
from pyspark.sql import functions as F

from redgreen.llm import topk

NAN, INF = float("nan"), float("inf")


def brute(rows, k, scale=64):
    vectors = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in vectors:
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i and len(v) == len(q))
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])}
    return out


def test_equals_a_full_sort(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(0, 0.3, 8)]) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 440)]  # ties: copies go by id
    rows += [(500, None), (None, rows[0][1]), (501, [NAN] * 8), (502, [INF] + [0.0] * 7), (503, [None] + [0.0] * 7)]
    rows += [(520, [0.5, 0.25]), (521, [0.5, -1.0])]  # another length: only with each other
    df = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id bigint, embedding array<float>, VEC_ID string")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    vectors = topk.scaled_vectors(df)
    got = topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=7, pivots=4, query_block=8, shard_rows=100)
    assert {tuple(x) for x in got.select("query_id", "rank", "vec_id", "score").collect()} == brute(rows, 7)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    got = topk.top_k(topk.scaled_vectors(df), F.col("vec_id") % 20 == 0)
    assert [tuple(r) for r in got.collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(topk.scaled_vectors(df.limit(0)), F.col("vec_id") % 20 == 0).isEmpty()


def test_bounds_stop_the_search_without_losing_a_row():
    r = np.random.default_rng(6)
    centres = r.integers(-60, 60, (10, 16))
    x = np.concatenate([c + r.integers(-2, 3, (300, 16)) for c in centres])
    ids = np.arange(len(x))
    pivots = x[::300].astype(float)
    for least in (None, np.array([0, 0])):
        for (places, found, scores, _), i in zip(topk.search_block((np.array([7, 1204]), x[[7, 1204]]), (ids, x), pivots, 20, least, step=64), (7, 1204)):
            want = sorted(((-int(x[i] @ x[j]), j) for j in ids if j != i))[:20]
            assert [(-s, j) for s, j in zip(scores.tolist(), found.tolist())] == want
    parts = list(topk.search_block((np.array([7, 1204]), x[[7, 1204]]), (ids, x), pivots, 20))
    assert sum(p[3] for p in parts) < len(x)  # of two queries
    assert not len(next(topk.search_block((ids[7:8], x[7:8]), (ids, x), pivots, 20, np.array([10**9])))[1])


def test_bounds_are_bounds():
    r = np.random.default_rng(7)
    q, x, pivots = (r.normal(0, 50, (n, 12)) for n in (40, 300, 64))
    bound = topk.score_bounds(q, topk.distances(q, pivots), x, topk.distances(x, pivots))
    assert (bound >= q @ x.T).all()


def test_clusters_are_left_out_whole(spark):
    """Where vectors lie in clusters most shards are never asked, and of the others most rows are never scored."""
    r = np.random.default_rng(8)
    centres = r.normal(0, 1, (20, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, [float(y) for y in centres[i % 20] + r.normal(0, 0.01, 16)]) for i in range(2000)]
    vectors = topk.scaled_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    found = topk.search(vectors, F.col("vec_id") % 20 == 0, 10, pivots=40, shard_rows=100).cache()
    counts = found.where("vec_id is null").agg(F.sum("met").alias("met"), F.sum("evaluated").alias("evaluated")).first()
    assert counts["met"] < 0.5 * 100 * 2000 and counts["evaluated"] < 0.2 * 100 * 2000
    got = topk.top_k(vectors, F.col("vec_id") % 20 == 0, 10, pivots=40, shard_rows=100)
    assert {tuple(x) for x in got.collect()} == brute(rows, 10)


def test_large_cells_have_several_shards():
    facts = [(2, 0, 5, 0, 0, 0), (2, 1, 30, 0, 0, 0), (2, 2, 4, 0, 0, 0), (2, 3, 4, 0, 0, 0), (3, 0, 2, 0, 0, 0)]
    assert topk.shards_of(facts, 10) == [(2, 0, 0, 1), (2, 1, 1, 3), (2, 2, 4, 1), (2, 3, 4, 1), (3, 0, 5, 1)]


def test_large_components_stay_exact():
    big = np.array([[2**30 + 1, 3]])
    (_, found, scores, _), = topk.search_block((np.array([0]), big), (np.array([1]), big), np.zeros((1, 2)), 5, np.array([(2**30 + 1) ** 2 + 9]))
    assert scores.tolist() == [(2**30 + 1) ** 2 + 9]
