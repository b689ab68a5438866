import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayframe.operators import gates as K
from assayframe.operators import matching as E
from assayframe.operators import metrics as I
from assayframe.operators import prep as H
from assayframe.operators import properties as P


def test_fit_matches_numpy_per_fold(spark):
    rnd = np.random.default_rng(0)
    n = 300
    x = rnd.normal(size=(n, 4)) * [1, 10, 100, 1] + [0, 5, 1000, 2]
    x[:, 3] = x[:, 0] * 2 + 1
    x[rnd.random((n, 4)) < 0.1] = np.nan
    y = x[:, 1] * 0.3 + rnd.normal(size=n)
    y = np.where(np.isnan(y), 0.0, y)
    fold = [str(i % 3) for i in range(n)]
    rows = [(i, fold[i], float(y[i]), *[None if np.isnan(v) else float(v) for v in x[i]], 4.0, None) for i in range(n)]
    feats = ["a", "b", "c", "d", "flat", "void"]
    df = spark.createDataFrame(rows, "id int, fold string, y double, a double, b double, c double, d double, flat double, void double")
    got = H.fit_folds(df, feats, "y", "fold", ["0", "1", "2"], limit=0.99)
    for f in "012":
        tr = np.array([z != f for z in fold])
        t = x[tr]
        med = np.nanmedian(t, axis=0)
        t = np.where(np.isnan(t), med, t)
        p = got[f]
        assert p.dropped["flat"] == "zero variance" and p.dropped["void"] == "all missing"
        for i, name in enumerate("abcd"):
            assert math.isclose(p.median[name], med[i], rel_tol=1e-12)
            if name in p.kept:
                assert math.isclose(p.mean[name], t[:, i].mean(), rel_tol=1e-9)
                assert math.isclose(p.scale[name], t[:, i].std(), rel_tol=1e-9)
    # Statistics of a fold's training side ignore its own rows.
    other = df.withColumn("a", (df.a + (df.fold == "0").cast("int") * 1e6))
    again = H.fit_folds(other, feats, "y", "fold", ["0"], limit=0.99)["0"]
    assert math.isclose(again.median["a"], got["0"].median["a"]) and math.isclose(again.mean.get("a", 0), got["0"].mean.get("a", 0), abs_tol=1e-3)


def test_pruning_rule():
    r = np.array([[1, 0.99, 0.2], [0.99, 1, 0.2], [0.2, 0.2, 1]])
    assert H.redundant(r, np.array([0.5, 0.5, 0.1]), 0.95, [False] * 3) == {1}
    assert H.redundant(r, np.array([0.5, 0.6, 0.1]), 0.95, [False] * 3) == {0}
    assert H.redundant(r, np.array([0.5, 0.6, 0.1]), 0.95, [True, True, False]) == set()
    assert H.redundant(r, np.array([0.9, 0.6, 0.1]), 0.95, [False, True, False]) == {0}


def test_scale(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 1.0), (9.0, 0.0)], "a double, y double")
    p = H.fit(df, ["a"], "y")
    assert p.mean["a"] == 4 and round(p.scale["a"], 6) == 3.559026


def one(df):
    return df.first().asDict()


def test_metrics(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 2.0), (4.0, 2.0)], "y_true double, y_pred double")
    m = one(I.evaluate(df, []))
    assert m["mae"] == 1.0 and round(m["rmse"], 6) == 1.290994 and m["r2"] == 0.375
    assert m["mae_nonmetals"] == 1.0 and m["mrae"] == 0.25 and m["mape"] == 25 and not m["diverged"]
    zeros = spark.createDataFrame([(0.0, 0.5), (0.0, 0.1)], "y_true double, y_pred double")
    z = one(I.evaluate(zeros, []))
    assert z["mrae"] is None and z["mae_nonmetals"] is None and z["r2"] == 0.0
    bad = spark.createDataFrame([(1.0, float("nan")), (2.0, 2.0)], "y_true double, y_pred double")
    b = one(I.evaluate(bad, []))
    assert b["diverged"] and b["mae"] is None


def test_bootstrap_paired_epochs(spark):
    v = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0), ("b", 2, 3.0)], "split string, seed int, mae double")
    ci = {r["split"]: (r["ci_lo"], r["ci_hi"]) for r in I.bootstrap_ci(v, "split", "mae", ["seed"], n_boot=200).collect()}
    assert ci["a"] == (None, None) and ci["b"] == (1.0, 3.0)
    res = spark.createDataFrame([("m", "full", 42, 1.0), ("m", "full", 43, 2.0), ("m", "dedup", 42, 0.5)], "model string, arm string, seed int, mae double")
    d = {r["contrast"]: r for r in I.paired_deltas(res).collect()}
    assert d["total"]["mean_delta"] == 0.5 and d["total"]["std_delta"] is None and d["total"]["n_seeds"] == 1 and "volume" not in d
    c = spark.createDataFrame([("r", 1, 3.0), ("r", 2, 1.0), ("r", 3, 1.0)], "run string, epoch int, val_mae double")
    assert I.best_epoch(c, ["run"], "epoch", "val_mae").first()["best_epoch"] == 2
    assert I.best_epoch(c, ["run"], "epoch", "val_mae", ties="latest").first()["best_epoch"] == 3


def test_completeness(spark):
    exp = spark.createDataFrame([("A",), ("B",)], "fold string")
    res = spark.createDataFrame([("A", 1.0)], "fold string, mae double")
    out, missing = I.publish_if_complete(exp, res, ["fold"])
    assert out is None and [r[0] for r in missing.collect()] == ["B"]
    assert I.publish_if_complete(exp.where("fold = 'A'"), res, ["fold"])[0] is not None


def test_property_policies(spark):
    comp = spark.createDataFrame([(1, "A", 1.0), (1, "B", 5.0), (1, "C", 2.0), (2, "A", 1.0), (2, "B", 1.0), (3, "B", 1.0)], "row_id int, element string, amount double")
    props = spark.createDataFrame([("A", 10.0), ("B", None), ("C", 40.0)], "element string, v double")
    got = {r["row_id"]: r for r in P.build_blocks(comp, props, [P.stats_block(["v"])]).collect()}
    assert (got[1]["v_mean"], got[1]["v_min"], got[1]["v_max"], got[1]["v_range"]) == (30, 10, 40, 30) and got[3]["v_mean"] is None
    ph = spark.createDataFrame([("A", 4.0, 1.0, 2.0, 1.0, 7.0, 1.0, 0.0), ("B", None, None, 2.0, None, None, 2.0, 1.0), ("C", 0.75, 3.0, 1.0, 1.0, 1.0, 3.0, 0.0)],
                               "element string, valence double, chi double, ie double, ea double, polarizability double, z double, f_flag double")
    r = {x["row_id"]: x for x in P.build_blocks(comp, ph, [P.physics_block()]).collect()}
    assert r[2]["phys_vec_per_atom"] == 2.0 and r[2]["phys_dist_octet"] == 6 and r[2]["phys_dist_18e"] == 16
    assert r[2]["phys_mean_polarizability"] is None and r[3]["phys_max_dchi"] == 0.0 and r[1]["phys_max_dchi"] == 2.0
    assert r[1]["phys_parity_odd"] == 0.0  # 4 + 1.5 = 5.5 rounds to 6
    with pytest.raises(ValueError):
        P.build_tier(comp, props, "physics_v9", {})


def test_fidelity_equals_the_pairs(spark):
    import random

    rnd = random.Random(4)
    mk = lambda n: [(rnd.choice(["hot", "hot", "k1", "k2", None, f"u{rnd.randint(0, 9)}"]), None if rnd.random() < 0.1 else round(rnd.uniform(-50, 900), 2)) for _ in range(n)]
    a, b = mk(120), mk(90)
    da, db = (spark.createDataFrame(x, "key string, value double") for x in (a, b))
    got = one(E.fidelity(da, db))
    pairs = [(x, y) for k, x in a for j, y in b if k is not None and k == j]
    full = np.array([(x, y) for x, y in pairs if x is not None and y is not None])
    assert got["n_compared_pairs"] == len(pairs) and got["n_expt"] == sum(k is not None for k, _ in a)
    assert math.isclose(got["mean_signed_diff"], (full[:, 0] - full[:, 1]).mean(), rel_tol=1e-9)
    assert math.isclose(got["mae"], np.abs(full[:, 0] - full[:, 1]).mean(), rel_tol=1e-9)
    assert math.isclose(got["pearson_r"], np.corrcoef(full.T)[0, 1], rel_tol=1e-7)


def test_alignment_and_subsets(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "row_id int, key string")
    assert E.assert_aligned(a, a, "row_id", "key") is a
    with pytest.raises(RuntimeError):
        E.assert_aligned(a, a.where("row_id = 1"), "row_id", "key")
    tr = spark.createDataFrame([("s", "f", 1), ("s", "g", 1)], "split string, fold string, row_id int")
    sub = spark.createDataFrame([("s", "f", "dedup", 1)], "split string, fold string, arm string, row_id int")
    with pytest.raises(KeyError):
        E.apply_subset(tr, sub, "dedup")
    assert E.apply_subset(tr.where("fold = 'f'"), sub, "dedup").count() == 1


def test_gates(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, None), (2, None, None)], "k int, s string, v double")
    base = K.fingerprint(df).first().asDict()
    assert K.fingerprint(df.repartition(5).orderBy("k")).first().asDict() == base
    assert K.fingerprint(df.distinct()).first().asDict() != base
    assert K.verify_table(df, base)["rows"] == 3
    with pytest.raises(RuntimeError):
        K.verify_table(df, {**base, "rows": 4})
    rec = K.verify_parts(df, "k", 2)
    assert not rec["pinned"] and K.verify_parts(df, "k", 2, rec["manifest"])["pinned"]
    with pytest.raises(RuntimeError):
        K.verify_parts(df, "k", 2, "0" * 32)
    with pytest.raises(RuntimeError):
        K.verify_parts(df, "k", 3)
    assert K.verify_parts(None, "k", 2, allow_absent=True)["absent"]


def test_pairs_of_a_hot_key_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(E, "PAIRS_A_TASK", 50)
    a = spark.createDataFrame([("x", float(i)) for i in range(30)] + [("y", 1.0), ("y", 1.0), (None, 2.0), ("z", 3.0)], "key string, value double")
    b = spark.createDataFrame([("x", float(i % 7)) for i in range(40)] + [("y", None), ("y", 4.0), (None, 2.0), ("w", 1.0)], "key string, value double")
    got = E.fidelity_pairs(a, b)
    plain = a.where("key is not null").select("key", F.col("value").alias("a")).join(b.select("key", F.col("value").alias("b")), "key")
    assert sorted(map(repr, got.drop("diff").collect())) == sorted(map(repr, plain.collect()))
    places = got.where("key = 'x'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(places) > 3 and max(r["count"] for r in places) < 30 * 40 / 2


def test_tiles_of_pairs_copy_few_rows(spark, monkeypatch):
    """Every part of a key once held all rows of one side: 40,000 copies for the 40,000 pairs of the key x."""
    monkeypatch.setattr(E, "PAIRS_A_TASK", 100)
    a = spark.createDataFrame([("x", float(i)) for i in range(200)] + [("n", float(i)) for i in range(300)] + [("m", None), ("o", 1.0)], "key string, value double")
    b = spark.createDataFrame([("x", float(i % 9)) for i in range(200)] + [("n", 1.0)] + [("m", float(i)) for i in range(300)] + [("o", None), ("o", 1.0)], "key string, value double")
    sent, repartition = [], type(a).repartition
    monkeypatch.setattr(type(a), "repartition", lambda self, *args: (sent.append(self.where("key = 'x'").count()), repartition(self, *args))[1])
    got = E.fidelity_pairs(a, b)
    plain = a.select("key", F.col("value").alias("a")).join(b.select("key", F.col("value").alias("b")), "key")
    assert sorted(map(repr, got.drop("diff").collect())) == sorted(map(repr, plain.collect()))
    assert len(sent) == 2 and 400 < sum(sent) < 40_000 / 4
    places = got.where("key = 'x'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(places) > 20 and max(r["count"] for r in places) < 40_000 / 8


def test_sweep_draws_the_sides_of_all_fits_once(spark):
    import hashlib

    from assayframe.operators import models as J

    rows = [(i, "abc"[i % 3], float(i)) for i in range(95)]
    df = spark.createDataFrame(rows, "id long, fold string, y double")
    seen, plans = {}, []

    def estimator(own, target, features, seed):
        plans.append(own._jdf.queryExecution().toString())
        sides = {r["row_id"]: r["role"] for r in own.collect()}
        seen[seed, frozenset(k for k, v in sides.items() if v == "test")] = {k for k, v in sides.items() if v == "val"}
        return own.where("role = 'test'").withColumn("y_pred", F.lit(1.0)), {}

    out = J.sweep(df, "y", [], ["a", "c"], [42, 7], row_id="id", estimator=estimator).collect()
    assert len(out) == 2 * (32 + 31) and set(out[0].asDict()) == {"fold", "seed", "id", "y_true", "y_pred"}
    assert not any("md5" in p for p in plans)  # no pass of a fit repeats the draws
    for fold in "ac":
        test = frozenset(i for i, f, _ in rows if f == fold)
        for seed in (42, 7):
            drawn = sorted((hashlib.md5(f"{seed}:val/{fold}:{i}".encode()).hexdigest(), i) for i, f, _ in rows if f != fold)
            assert seen[seed, test] == {i for _, i in drawn[: (95 - len(test)) // 10]}
