"""Blocked cross products against numpy on the whole table."""

import numpy as np
import pytest

from assayframe.operators import prep as H
from assayframe.operators import wide as W


def table(spark, n, p, seed=0, folds=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, max(2, p // 6)))
    x = base[:, rng.integers(0, base.shape[1], p)] * rng.uniform(1, 50, p) + rng.normal(size=(n, p)) * rng.uniform(0, 6, p) + 1000 * rng.normal(size=p)
    x[:, p // 2] = 3.0
    gaps = rng.random((n, p)) < np.where(np.arange(p) % 3 == 0, 0.1, 0.0)
    x[gaps] = np.nan
    x[:, 1] = np.nan
    y = base[:, 0] + rng.normal(size=n)
    fold = rng.integers(0, folds, n)
    rows = [(str(fold[i]), float(y[i]), *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    names = [f"c{k}" for k in range(p)]
    schema = "fold string, y double, " + ", ".join(f"{c} double" for c in names)
    return x, y, fold, names, spark.createDataFrame(rows, schema).repartition(4)


def plain(x, y, limit):
    """Kept columns and their statistics, from the rows."""
    med = np.array([np.nan if np.isnan(c).all() else np.nanmedian(c) for c in x.T])
    use = [k for k in range(x.shape[1]) if not np.isnan(med[k])]
    t = np.where(np.isnan(x), med, x)
    sd = {k: t[:, k].std() if t[:, k].min() != t[:, k].max() else 0.0 for k in use}
    live = [k for k in use if sd[k] > 0]
    r = np.corrcoef(t[:, live].T)
    to_y = np.abs([np.corrcoef(t[:, k], y)[0, 1] for k in live])
    inside = np.ones(len(live), bool)
    for i in range(len(live)):
        for j in range(i + 1, len(live)):
            if abs(r[i, j]) > limit and inside[i] and inside[j]:
                inside[i if to_y[i] < to_y[j] else j] = False
    return {live[k]: (t[:, live[k]].mean(), sd[live[k]]) for k in range(len(live)) if inside[k]}


@pytest.mark.parametrize("p,block", [(25, 128), (25, 4), (60, 7)])
def test_blocks_keep_what_the_rule_keeps(spark, p, block):
    x, y, fold, names, df = table(spark, 200, p, seed=p + block)
    got = H.fit_folds(df, names, "y", "fold", ["0", "1", "2"], limit=0.9, block=block)
    for label in "012":
        side = fold != int(label)
        want = plain(x[side], y[side], 0.9)
        fit = got[label]
        assert fit.kept == [names[k] for k in want]
        for k, (mean, sd) in want.items():
            assert np.isclose(fit.mean[names[k]], mean, rtol=1e-9) and np.isclose(fit.scale[names[k]], sd, rtol=1e-6)
        assert fit.dropped[names[1]] == "all missing" and fit.dropped[names[p // 2]] == "zero variance"


def test_sums_are_sent_when_they_fill_the_memory(spark, monkeypatch):
    x, y, fold, names, df = table(spark, 120, 20, seed=3)
    want = H.fit_folds(df, names, "y", "fold", ["0", "1", "2"], limit=0.9)
    monkeypatch.setattr(W, "HELD", 1)  # one fold at a time
    monkeypatch.setattr(W, "SLICE", 7)
    got = H.fit_folds(df, names, "y", "fold", ["0", "1", "2"], limit=0.9)
    assert {f: (p.kept, p.dropped) for f, p in got.items()} == {f: (p.kept, p.dropped) for f, p in want.items()}


def test_rows_without_target_or_fold(spark):
    rows = [(None, 1.0, 1.0, 2.0), ("a", None, 50.0, 9.0), ("a", 3.0, 4.0, 7.0), ("b", 2.0, 2.0, 1.0), ("b", 5.0, 8.0, 3.0)]
    df = spark.createDataFrame(rows, "fold string, y double, u double, v double")
    got = H.fit_folds(df, ["u", "v"], "y", "fold", ["a", "b"], limit=0.99)
    # a row without a fold trains every side; one without a target counts for the medians only
    assert np.isclose(got["a"].mean["u"], (1 + 2 + 8) / 3) and np.isclose(got["b"].mean["u"], (1 + 4) / 2)


def test_a_wide_table_sends_only_pairs_above_the_limit(spark):
    x, y, fold, names, df = table(spark, 150, 400, seed=9, folds=2)
    got = H.fit_folds(df, names, "y", "fold", ["0"], limit=0.95, block=64)["0"]
    assert got.kept == [names[k] for k in plain(x[fold != 0], y[fold != 0], 0.95)]
