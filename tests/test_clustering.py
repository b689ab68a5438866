"""Clusters that do not depend on how rows lie, against a plain rewrite."""

import hashlib
import math

import numpy as np
import pytest

from assayframe.operators import clustering as K
from assayframe.operators import splits as S


def plain(rows, k, seed, steps, unit=1e-6):
    """Integer arithmetic throughout, one point at a time."""
    q = {i: [math.floor(x / unit + 0.5) for x in v] for i, v in rows}
    n, p = len(q), len(next(iter(q.values())))
    sums = [sum(v[d] for v in q.values()) for d in range(p)]
    squares = [sum(v[d] ** 2 for v in q.values()) for d in range(p)]
    mean = [float(s) / n for s in sums]
    sd = [float(n * t - s * s) ** 0.5 / n for s, t in zip(sums, squares)]
    z = {i: [math.floor((v[d] - mean[d]) / sd[d] * 65536 + 0.5) if sd[d] > 0 else 0 for d in range(p)] for i, v in q.items()}
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    u = lambda r, i: (int(hashlib.md5(f"{seed}:centre/{r}:{i}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
    centres = []
    for r in range(k):
        far = {i: min((dist(v, c) for c in centres), default=1) for i, v in z.items()}
        race = [(-math.log(u(r, i)) / far[i], i) for i in z if far[i] > 0]
        if race:
            centres.append(z[min(race)[1]])
    label = lambda: {i: min(range(len(centres)), key=lambda j: (dist(v, centres[j]), j)) for i, v in z.items()}
    for _ in range(steps):
        of = label()
        for j in range(len(centres)):
            mine = [z[i] for i in z if of[i] == j]
            if mine:
                centres[j] = [sum(v[d] for v in mine) // len(mine) for d in range(p)]
    return label(), centres


def points(n=150, p=5, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 1, (n, p)) + 6 * rng.integers(0, 3, (n, 1))
    v[:, 1] = 2.5
    v[10:20] = v[10]
    return [(i, x.tolist()) for i, x in enumerate(v)]


@pytest.mark.parametrize("k,steps", [(1, 3), (4, 0), (4, 6), (9, 3)])
def test_equals_a_plain_rewrite(spark, k, steps):
    rows = points()
    df = spark.createDataFrame(rows, "row_id long, v array<double>")
    got, centres = K.clusters(df.repartition(4), "v", k, 7, steps)
    want, want_centres = plain(rows, k, 7, steps)
    assert {r.row_id: r.cluster for r in got.collect()} == want and centres == want_centres


def test_same_clusters_under_any_partitioning(spark):
    df = spark.createDataFrame(points(300, 7, 3), "row_id long, v array<double>")
    runs = []
    for cut in (df.coalesce(1), df.repartition(13), df.orderBy(-df.row_id).repartition(5, "row_id")):
        got, centres = K.clusters(cut, "v", 5, 1)
        runs.append((sorted((r.row_id, r.cluster) for r in got.collect()), centres))
    assert runs[0] == runs[1] == runs[2]


def test_fewer_points_than_centres(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [4.0, 0.0])]
    got, centres = K.clusters(spark.createDataFrame(rows, "row_id long, v array<double>"), "v", 8)
    of = {r.row_id: r.cluster for r in got.collect()}
    assert len(centres) == 2 and of[1] == of[2] != of[3]


def test_rows_without_a_usable_vector_are_left_out(spark):
    rows = [*points(40), (900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (902, [float("nan")] * 5), (903, [1.0]), (904, [float("inf")] * 5)]
    got, _ = K.clusters(spark.createDataFrame(rows, "row_id long, v array<double>"), "v", 3)
    assert {r.row_id for r in got.collect()} == set(range(40))
    empty = spark.createDataFrame([], "row_id long, v array<double>")
    assert K.clusters(empty, "v", 3)[1] == [] and S.feature_holdout(empty, "v") is None


def test_holdout_is_the_farthest_cluster(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0, 0.1, 3) + (9 if i < 35 else 0)).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, v array<double>")
    out = S.feature_holdout(df, "v", k=2)
    assert {r.row_id for r in out.where("is_test").collect()} == set(range(35))
    assert S.feature_holdout(df, "v", k=2, min_test=36) is None
