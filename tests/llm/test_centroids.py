"""Clusters by bit planes against plain integer arithmetic."""

import hashlib
import math

import numpy as np

from redgreen.llm import centroids

NAN, INF = float("nan"), float("inf")


def brute(rows, k, rounds, seed=2):
    """Lloyd's rounds in Python integers over ``(vec_id, vector)``."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in order[:k]]

    def assign():
        out = []
        for _, v in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents)))
        return out

    for _ in range(rounds):
        found = assign()
        for n in range(len(cents)):
            own = [v for (_, v), (_, m) in zip(kept, found) if m == n]
            if own:
                cents[n] = [sum(col) // len(own) for col in zip(*own)]
    found = assign()
    total = sum(d for d, _ in found)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, n, d, sum(e for e, m in found if m == n), total, digest[n]) for (i, _), (d, n) in zip(kept, found)), key=str)


def got(df, k, rounds):
    done = centroids.cluster(centroids.integer_vectors(df), k=k, rounds=rounds).drop("centroid")
    return sorted(map(tuple, done.collect()), key=str)


def test_equals_plain_arithmetic(spark):
    r = np.random.default_rng(3)
    middles = r.normal(0, 0.4, (6, 64))
    rows = [(i, [float(np.float32(x)) for x in middles[i % 6] + r.normal(0, 0.1, 64)]) for i in range(150)]
    rows += [(i, rows[4][1]) for i in range(150, 190)]  # copies
    rows += [(7, rows[9][1]), (None, rows[5][1])]  # an id twice, and none
    rows += [(300, None), (301, [0.5] * 63), (302, [NAN] + [0.0] * 63), (303, [None] + [0.0] * 63), (304, [INF] + [0.0] * 63), (305, [])]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id bigint, embedding array<float>, CLUSTER string")
    assert got(df, 7, 3) == brute(rows, 7, 3)


def test_fewer_rows_than_centroids_and_none(spark):
    rows = [(1, [0.25] * 64), (2, [-1.0] * 64), (3, [0.25] * 64)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert got(df, 40, 5) == brute(rows, 40, 5)
    assert got(df.limit(0), 40, 5) == []
    assert got(spark.createDataFrame([(None, [0.5] * 64)], df.schema), 40, 5) == []


def test_planes_carry_every_sign_and_size():
    r = np.random.default_rng(4)
    values = np.concatenate([r.integers(-(1 << 27) + 1, 1 << 27, (20, 64)), np.full((1, 64), -(1 << 27)), np.zeros((1, 64), dtype=np.int64)])
    x = centroids.planes_of(values, 28)
    assert (centroids.products(x, x) == values @ values.T).all()
    assert (centroids.squares(x) == (values**2).sum(axis=1)).all()
    assert (centroids.component_sums(x) == values.sum(axis=0)).all()


def test_too_large_components_are_left_out(spark):
    rows = [(1, [0.5] * 64), (2, [1e30] + [0.0] * 63)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert [r["vec_id"] for r in centroids.integer_vectors(df).collect()] == [1]
