"""Clusters by kd-trees against plain k-means in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from quern.llm import kdtree as K

EXTRA = ", cluster int, v array<double>, n long, distance string, hash string"


def plain(rows, k, rounds, size, salt="3"):
    """[(vec_id, cluster, distance, cluster_inertia, inertia, sha)] of the rows that take part."""
    good = [(i, v) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    own = [(i, [K.whole(x) for x in v]) for i, v in good]
    key = lambda r: (r[0][0] is None, hashlib.sha256(f"{salt}:{r[0][0]}".encode()).hexdigest(), r[1])
    order = sorted(zip(own, [v for _, v in good], strict=True), key=key)
    at = [v for (_, v), _ in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min(range(len(at)), key=lambda c: (dist(v, at[c]), c)) for _, v in own]
    for _ in range(rounds):
        got = assign()
        for c in range(len(at)):
            mine = [v for (_, v), w in zip(own, got, strict=True) if w == c]
            if mine:
                at[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    got = assign()
    d = [dist(v, at[w]) for (_, v), w in zip(own, got, strict=True)]
    fit = lambda x, parts: x if x < 1 << 63 and all(p < 1 << 63 for p in parts) else None
    out = []
    for (i, _), w, x in zip(own, got, d, strict=True):
        mine = [y for y, c in zip(d, got, strict=True) if c == w]
        out.append((i, w, x if x < 1 << 63 else None, fit(sum(mine), mine), fit(sum(d), d), hashlib.sha256(",".join(map(str, at[w])).encode()).hexdigest()))
    return out


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def odd(size):
    return [(900, None), (901, [0.5] * (size - 1)), (902, [0.5] * (size - 1) + [None]), (903, [float("nan")] * size), (904, [float("inf")] + [0.0] * (size - 1)), (905, []), (None, [0.25] * size), (None, None)]


@pytest.mark.parametrize("size", [2, 64])
def test_clusters_equal_plain_k_means(spark, size, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 70)
    monkeypatch.setattr(K, "LEAF", 5)
    rng = random.Random(size)
    middle = [[rng.uniform(-2, 2) for _ in range(size)] for _ in range(5)]
    rows = [(i, [m + rng.gauss(0, 0.2) for m in middle[i % 5]]) for i in range(300)]
    rows += [(i + 300, [0.125] * size) for i in range(40)] + [rows[0], rows[3]] + odd(size)
    df = spark.createDataFrame([(*r, 1, [1.0], 2, "d", "h") for r in rows], "vec_id long, embedding array<double>" + EXTRA).repartition(3)
    same(K.clustered(df, size=size).collect(), plain(rows, 8, 10, size))


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate((x, y) for x in range(-3, 4) for y in range(-3, 4))] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k, rounds in ((8, 0), (8, 1), (4, 10), (3, 3)):
        same(K.clustered(df, k, rounds, size=2).collect(), plain(rows, k, rounds, 2))


def test_values_beyond_floats_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e300, -1e305, 3.5, 2.0**60 + 4096, -7e9, 1e-300]) * rng.choice([1, 1, -1]), rng.uniform(-1e7, 1e7)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    same(K.clustered(df, size=2).collect(), plain(rows, 8, 10, 2))


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0]), (2, [3.0, 1.0]), (2, [3.0, 1.0]), (None, [0.0, 0.0])], "vec_id long, embedding array<float>")
    same(K.clustered(df, size=2).collect(), plain([(1, [0.5, 1.0]), (2, [3.0, 1.0]), (2, [3.0, 1.0]), (None, [0.0, 0.0])], 8, 10, 2))
    for none in (df.limit(0), df.where("vec_id = 7"), df.select("vec_id", df.embedding.cast("array<double>").alias("embedding")).where("vec_id is null").selectExpr("vec_id", "array(1d) embedding")):
        assert K.clustered(none, size=2).collect() == []


def test_nodes_are_assigned_whole_where_clusters_lie_apart(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.1, (500, 3)) for c in (0, 50, 100)])
    at = np.array([[0] * 3, [51200] * 3, [102400] * 3], object)
    forest = K.trees(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>").coalesce(1), 3)
    got = K.totals(forest, at)
    assert {w: n for w, (n, _, _) in got.items()} == {0: 500, 1: 500, 2: 500}
    assert sum(looked for _, _, looked in got.values()) < 150  # of 1,500: only leaves on the borders
    ints = np.floor(points * 1024).astype(int)
    assert all(got[w][1] == ints[500 * w : 500 * w + 500].sum(0).tolist() for w in range(3))
