import pytest
from pyspark.sql import functions as F

from assayframe.operators import splits as S
from assayframe.operators.ranking import exact_quantiles, global_rank


def ids(spark, n, **cols):
    df = spark.range(n).select(F.col("id").alias("row_id"))
    for k, e in cols.items():
        df = df.withColumn(k, F.expr(e))
    return df


def test_random_parts_sizes_and_stability(spark):
    df = ids(spark, 1000)
    a = {r["row_id"]: r["part"] for r in S.random_parts(df.repartition(1)).collect()}
    b = {r["row_id"]: r["part"] for r in S.random_parts(df.repartition(8)).collect()}
    assert a == b
    sizes = {p: list(a.values()).count(p) for p in ("train", "val", "test")}
    assert sizes["test"] == 150 and sizes["val"] in (150, 151) and sum(sizes.values()) == 1000


def test_lomo(spark):
    df = spark.createDataFrame([(0, "A"), (1, "A"), (2, "multi"), (3, "Others"), (4, "B")], "row_id int, category string")
    m = {r["fold"]: (r["n_test"], r["n_train"]) for r in S.manifest(S.expand_folds(S.leave_one_category_out(df), "lomo")).collect()}
    assert m == {"A": (2, 3), "B": (1, 4)}


def test_stratified_quotas_with_a_hot_stratum(spark):
    df = ids(spark, 1003, stratum="case when row_id % 3 = 0 then 'hot' when row_id < 9 then 'tiny' else concat('s', row_id % 5) end")
    out = S.stratified_holdout(df).collect()
    n_test = sum(r["is_test"] for r in out)
    assert n_test == 101
    per = {}
    for r in out:
        per.setdefault(r["stratum"], []).append(r["is_test"])
    assert all(abs(sum(v) - 0.1 * len(v)) < 1.01 for v in per.values())


def test_data_efficiency_is_nested(spark):
    df = ids(spark, 600, stratum="concat('s', row_id % 4)")
    rows = S.data_efficiency(df).collect()
    train = {f: {r["row_id"] for r in rows if r["fold"] == f and r["role"] == "train"} for f in ("10pct", "25pct", "50pct", "100pct")}
    test = {f: {r["row_id"] for r in rows if r["fold"] == f and r["role"] == "test"} for f in train}
    assert train["10pct"] <= train["25pct"] <= train["50pct"] <= train["100pct"]
    assert len(train["10pct"]) == 54 and len(train["100pct"]) == 540
    assert all(t == test["10pct"] and not (t & train["100pct"]) for t in test.values())


@pytest.mark.parametrize("deal", [False, True])
def test_groups_never_cross_folds(spark, deal):
    df = ids(spark, 400, g="case when row_id % 3 = 0 then 'big' when row_id < 50 then null else concat('g', row_id % 17) end")
    out, k = S.group_kfold(df, "g", 5, deal=deal)
    got = out.join(df, "row_id").collect()
    assert k == 5 and len({r["fold"] for r in got}) == 5 and all(r["g"] is not None for r in got)
    assert all(len({r["fold"] for r in got if r["g"] == g}) == 1 for g in {r["g"] for r in got})


def test_balanced_groups(spark):
    df = spark.createDataFrame([(i, "a" if i < 5 else "b" if i < 8 else "c") for i in range(10)], "row_id int, g string")
    out, k = S.group_kfold(df, "g", 2)
    sizes = sorted(r["count"] for r in out.groupBy("fold").count().collect())
    assert k == 2 and sizes == [5, 5]
    assert S.group_kfold(df.withColumn("g", F.lit("x")), "g", 2) == (None, 0)


def test_range_extrapolation(spark):
    df = spark.createDataFrame(list(enumerate([1.0, 2.0, 5.0, 6.0, 7.0])), "row_id int, y double")
    m = {r["fold"]: (r["n_train"], r["n_test"]) for r in S.manifest(S.range_extrapolation(df, "y", 4.0, min_test=1)).collect()}
    assert m == {"extrapolation": (2, 3), "random_control": (2, 3), "inrange_control": (3, 2)}
    with pytest.raises(ValueError):
        S.range_extrapolation(df, "y", 4.0)


def test_global_rank_and_quantiles(spark):
    df = ids(spark, 500, v="cast(case when row_id % 3 = 0 then 7 else (row_id * 37) % 101 end as double)", k="if(row_id % 3 = 0, 'hot', 'cold')")
    ranked = global_rank(df.repartition(5), ["v", "row_id"]).collect()
    assert [r["rank"] for r in sorted(ranked, key=lambda r: (r["v"], r["row_id"]))] == list(range(500))
    want = {(r["k"], p): r[f"p{i}"] for i, p in enumerate((0.1, 0.5, 0.9)) for r in df.groupBy("k").agg(F.percentile("v", F.lit(p)).alias(f"p{i}")).collect()}
    got = {(r["k"], r["prob"]): r["quantile"] for r in exact_quantiles(df, ["k"], "v", [0.1, 0.5, 0.9]).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
