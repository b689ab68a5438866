"""Elastic nets from cross products against fits on the rows."""

import hashlib

import numpy as np
import pytest

from assayframe.operators import linear as L


def direct(x, y, reg, mix, steps=60_000):
    """Proximal gradient on the rows themselves."""
    mean, sd = x.mean(0), x.std(0)
    use = sd > 1e-12
    z = (x[:, use] - mean[use]) / sd[use]
    r = y - y.mean()
    w = np.zeros(use.sum())
    rate = 1 / (np.linalg.eigvalsh(z.T @ z / len(y)).max() + reg)
    for _ in range(steps):
        grad = z.T @ (z @ w - r) / len(y) + reg * (1 - mix) * w
        v = w - rate * grad
        new = np.sign(v) * np.maximum(np.abs(v) - rate * reg * mix, 0)
        if np.abs(new - w).max() < 1e-14:
            break
        w = new
    coef = np.zeros(x.shape[1])
    coef[use] = w / sd[use]
    return y.mean() - coef @ mean, coef


def data(n=240, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(5, 2, n), rng.normal(-100, 30, n), np.full(n, 7.0), rng.integers(0, 3, n)])
    x[:, 3] += 0.2 * x[:, 0]
    return x, 3 * x[:, 0] - 0.1 * x[:, 1] + x[:, 3] + rng.normal(0, 1, n) + 50


@pytest.mark.parametrize("reg,mix", [(0.0, 0.0), (0.7, 0.0), (0.7, 1.0), (0.7, 0.4), (50.0, 0.5)])
def test_solution_equals_a_fit_on_the_rows(reg, mix):
    x, y = data()
    z = np.column_stack([np.ones(len(y)), y - 40, x - [1, -90, 7, 0]])
    [(a, b)] = L.solve(z.T @ z, [(reg, mix)], np.array([40.0, 1, -90, 7, 0]))
    want_a, want_b = direct(x, y, reg, mix)
    assert np.allclose(b, want_b, atol=1e-8) and abs(a - want_a) < 1e-6 and b[2] == 0
    if reg == 50:
        assert not b.any()


def test_a_path_of_penalties_equals_single_fits():
    x, y = data(seed=2)
    z, grid = np.column_stack([np.ones(len(y)), y, x]), [(r, m) for r in (0.0, 0.2, 3.0) for m in (0.0, 0.5, 1.0)]
    path = L.solve(z.T @ z, grid, np.zeros(5))
    for g, (a, b) in zip(grid, path):
        [(c, d)] = L.solve(z.T @ z, [g], np.zeros(5))
        assert np.allclose(b, d, atol=1e-9) and abs(a - c) < 1e-7


def test_twins_without_penalty_share_the_weight():
    x, y = data(seed=3)
    z = np.column_stack([np.ones(len(y)), y, x[:, 0], x[:, 0]])
    [(_, b)] = L.solve(z.T @ z, [(0.0, 0.0)], np.zeros(3))
    assert abs(b[0] - b[1]) < 1e-9


def rows_of(spark, n=240):
    x, y = data(n)
    rng = np.random.default_rng(5)
    fold = rng.choice(["a", "b", "c", None], n).tolist()
    rows = [(i, fold[i], float(y[i]), *map(float, x[i])) for i in range(n)]
    rows[3] = (3, fold[3], None, *rows[3][3:])
    rows[4] = (4, fold[4], rows[4][2], None, *rows[4][4:])
    rows[6] = (6, fold[6], rows[6][2], float("nan"), *rows[6][4:])
    schema = "id long, fold string, y double, f0 double, f1 double, f2 double, f3 double"
    return rows, spark.createDataFrame(rows, schema).repartition(5)


FEATURES = ["f0", "f1", "f2", "f3"]


def test_sweep_equals_a_fit_for_each_fold_and_seed(spark):
    rows, df = rows_of(spark)
    penalties = [(0.0, 0.0), (0.3, 0.5)]
    pred, fits = L.elastic_sweep(df, "y", FEATURES, [42, 7], penalties, row_id="id")
    got = {(r.fold, r.seed, r.reg): (r.intercept, np.array(r.coef)) for r in fits.collect()}
    assert len(got) == 3 * 2 * 2
    for f in ("a", "b", "c"):
        others = [r for r in rows if r[1] != f]
        n_val = max(1, len(others) // 10)
        for s in (42, 7):
            order = sorted(others, key=lambda r: (hashlib.md5(f"{s}:val/{f}:{r[0]}".encode()).hexdigest(), r[0]))
            train = [r for r in order[n_val:] if r[2] is not None and r[3] is not None and not np.isnan(r[3])]
            x, y = np.array([r[3:] for r in train]), np.array([r[2] for r in train])
            for reg, mix in penalties:
                a, b = direct(x, y, reg, mix)
                assert np.allclose(got[f, s, reg][1], b, atol=1e-7) and abs(got[f, s, reg][0] - a) < 1e-5
    told = pred.collect()
    assert len(told) == sum(r[1] is not None for r in rows) * 4
    by_id = {r[0]: r for r in rows}
    for r in told:
        a, b = got[r.fold, r.seed, r.reg]
        x = by_id[r.id][3:]
        assert by_id[r.id][1] == r.fold
        if x[0] is None or np.isnan(x[0]):
            assert r.y_pred is None or np.isnan(r.y_pred)
        else:
            assert abs(r.y_pred - (a + b @ np.array(x))) < 1e-6


def test_jobs_do_not_grow_with_the_fits(spark):
    _, df = rows_of(spark)
    status = spark.sparkContext.statusTracker()

    def jobs(seeds):
        spark.sparkContext.setJobGroup(f"sweep-{len(seeds)}", "")
        L.elastic_sweep(df, "y", FEATURES, seeds, [(0.1, 0.0)], row_id="id")[0].collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(status.getJobIdsForGroup(f"sweep-{len(seeds)}"))

    assert jobs(list(range(9))) <= jobs([1]) + 2  # adaptive plans may differ by a stage


@pytest.mark.parametrize("log_target", [False, True])
def test_grid_equals_a_fit_for_each_point(spark, log_target):
    x, y = data(300, seed=8)
    role = np.random.default_rng(1).choice(["train", "val", "test"], 300).tolist()
    df = spark.createDataFrame([(role[i], float(y[i]), *map(float, x[i])) for i in range(300)], "role string, y double, f0 double, f1 double, f2 double, f3 double")
    out = L.elastic_grid(df.repartition(4), "y", FEATURES, (0.0, 0.2, 5.0), (0.0, 0.6), log_target=log_target).collect()
    seen = np.log1p(y) if log_target else y
    tr, va = np.array(role) == "train", np.array(role) == "val"
    for r in out:
        a, b = direct(x[tr], seen[tr], r.reg, r.mix)
        told = a + x[va] @ b
        assert abs(np.abs((np.expm1(told) if log_target else told) - y[va]).mean() - r.val_mae) < 1e-6
    assert [r.val_mae for r in out] == sorted(r.val_mae for r in out) and len(out) == 6


def test_grid_without_rows(spark):
    df = spark.createDataFrame([], "role string, y double, f0 double")
    assert L.elastic_grid(df, "y", ["f0"], (0.1,), (0.0,)).collect() == []
