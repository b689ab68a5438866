"""Missing values, large numbers and rules that must not change with size."""

import heapq
import itertools
import math

import numpy as np
import pytest

from assayframe.operators import composition as C
from assayframe.operators import gates as K
from assayframe.operators import metrics as I
from assayframe.operators import prep as H
from assayframe.operators import splits as S
from assayframe.plans import suite
from assayframe.sources.session import release, scratch_root, settle


def test_nan_is_missing_in_preparation(spark):
    rows = [(float(i), v, f"{i % 2}") for i, v in enumerate([1.0, 2.0, math.nan, math.nan, math.nan])]
    df = spark.createDataFrame(rows, "y double, x double, fold string")
    for got in (H.fit(df, ["x"], "y"), H.fit(df.selectExpr("y", "nullif(x, double('NaN')) AS x"), ["x"], "y")):
        assert got.kept == ["x"] and got.median["x"] == 1.5 and math.isclose(got.mean["x"], 1.5)
    assert [r.x for r in H.fit(df, ["x"], "y").transform(df, []).collect()][2:] == [0.0, 0.0, 0.0]
    assert {r.feature: r.quantile for r in H.medians(df, ["x"]).collect()} == {"x": 1.5}


def brute_redundant(r, to_target, limit, safe):
    out = set()
    for i, j in itertools.combinations(range(len(safe)), 2):
        if i in out or j in out or abs(r[i][j]) <= limit or (safe[i] and safe[j]):
            continue
        if safe[i] or safe[j]:
            out.add(j if safe[i] else i)
        else:
            out.add(i if to_target[j] > to_target[i] else j)
    return out


def test_redundant_columns_against_the_rule():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(1, 9))
        r = np.round(rng.uniform(-1, 1, (n, n)), 1)
        r = (r + r.T) / 2
        t, safe = np.round(rng.uniform(0, 1, n), 1), (rng.random(n) < 0.3).tolist()
        assert H.redundant(r, t, 0.4, safe) == brute_redundant(r, t, 0.4, safe)


def test_rows_without_a_truth_count_for_nothing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 9.0), (math.nan, None), (3.0, 2.0)], "y_true double, y_pred double")
    got = I.evaluate(df, []).first()
    assert (got.n_test, got.mae, got.rmse) == (2, 1.0, 1.0) and math.isclose(got.r2, 0.0, abs_tol=1e-12)
    bad = spark.createDataFrame([(1.0, None), (2.0, 2.0)], "y_true double, y_pred double")
    assert I.evaluate(bad, []).first().mae is None


def test_fingerprint_tells_rows_apart(spark):
    schema = "a double, b string, c string"
    rows = [(math.nan, "a|b", "c"), (0.0, "a|b", "c"), (1e13, "a|b", "c"), (2e15, "a|b", "c"), (1e-9, "a|b", "c"), (4e-7, "a|b", "c"),
            (0.0, "a", "b|c"), (0.0, None, "c"), (0.0, "\\N", "c"), (0.0, "~", "c"), (0.0, "", "c")]
    seen = {tuple(K.fingerprint(spark.createDataFrame([r], schema)).first()) for r in rows}
    assert len(seen) == len(rows)


def test_large_amounts_are_reduced(spark):
    rows = [(1, "A", 4e9), (1, "B", 2e9), (2, "A", 2.0**60), (2, "B", 3 * 2.0**58), (3, "A", 0.5), (3, "B", 1.0)]
    got = {r.row_id: r.key for r in C.reduced_key(spark.createDataFrame(rows, "row_id int, element string, amount double")).collect()}
    assert got == {1: "A:2 B:1", 2: "A:4 B:3", 3: "A:0.500000 B:1.000000"}


@pytest.mark.parametrize("k", [2, 3, 7])
def test_groups_go_to_the_lightest_fold(spark, k):
    sizes = {f"g{i:03d}": 1 + (i * 37 % 11) * (i % 3) for i in range(90)} | {"big": 200}
    df = spark.createDataFrame(list(sizes.items()), "grp string, size bigint")
    heap = [(0, f) for f in range(k)]
    want = {}
    for g, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, fold = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, fold))
        want[g] = str(fold)
    assert {r.grp: r.fold for r in S._balanced(df, k).collect()} == want


def test_long_series_stay(spark):
    df = spark.createDataFrame([(1, [0.5] * 12_000), (2, [1.0])], "run int, s array<double>")
    got = I.long_curves(df, ["run"], {("train", "mae"): "s"})
    assert got.count() == 12_000


def test_counts_without_the_long_form(spark):
    rows = [(i, None if i % 7 == 0 else f"f{i % 3}") for i in range(100)]
    df = spark.createDataFrame(rows, "row_id int, fold string")
    long = S.manifest(S.expand_folds(df, "s")).select("split", "fold", "n_train", "n_test")
    assert sorted(map(tuple, S.fold_counts(df, "s").collect())) == sorted(map(tuple, long.collect()))
    assert "Generate" not in S.fold_counts(df, "s")._jdf.queryExecution().executedPlan().toString()


def test_suite_without_wide_rows_skips_the_range_split(spark):
    rows = [(i, "ABC"[i % 3], "s" + str(i % 4), "g" + str(i % 2), float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id int, category string, system string, groups string, target double")
    got = {r.split: r for r in suite.suite_manifest(df, threshold=100.0).collect() if r.fold is None}
    assert "need" in got["extrapolation"].note and got["crystal_system"].note == "no column attribute"
    long, skipped = suite.build_suite(df, threshold=100.0)
    assert set(skipped) == {"extrapolation", "crystal_system"} and long.count() > 0


def test_released_tables_are_gone(spark):
    import os

    table = settle(spark.range(5).toDF("x"), "gone")
    folder = table.inputFiles()[0].split(":", 1)[1].rsplit("/", 1)[0]
    folder = "/" + folder.lstrip("/")
    assert os.path.isdir(folder) and folder.startswith("/" + scratch_root(spark).split(":", 1)[-1].lstrip("/"))
    release(table)
    assert not os.path.exists(folder)
    with pytest.raises(ValueError):
        release(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))


def test_large_bootstrap_brackets_the_mean(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "ab"[i % 2], float(v)) for i, v in enumerate(rng.normal(5, 2, 4000))] + [(9999, "c", 1.0), (10000, "d", None)]
    df = spark.createDataFrame(rows, "id int, k string, v double")
    got = {r.k: r for r in I.bootstrap_ci_large(df.repartition(3), "k", "v", "id").collect()}
    assert got["c"].ci_lo is None and "d" not in got
    for k in "ab":
        v = [r[2] for r in rows if r[1] == k]
        spread = 1.96 * np.std(v) / math.sqrt(len(v))
        assert abs(got[k].ci_lo - (np.mean(v) - spread)) < 0.4 * spread and abs(got[k].ci_hi - (np.mean(v) + spread)) < 0.4 * spread
    again = {r.k: r for r in I.bootstrap_ci_large(df.repartition(7), "k", "v", "id").collect()}
    assert math.isclose(again["a"].ci_lo, got["a"].ci_lo)
