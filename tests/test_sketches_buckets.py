"""Mergeable quantile sketches, and artifacts in buckets."""

import numpy as np
import pytest

from assayframe.operators import matching as E
from assayframe.operators import sketches as Q
from assayframe.sources.bucketed import attach, buckets_for, write_bucketed
from assayframe.sources.session import new_table_path, settle


def test_merged_sketches_are_near_in_rank(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate((rng.lognormal(0, 2, 20_000), np.full(9_000, 1.0)))
    rng.shuffle(values)
    rows = [(f"p{i % 7}", float(v), None if i % 3 else float(-i)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "part string, a double, b double")
    parts = settle(Q.sketched(df, ["a", "b"], "part", k=400), "sketches")
    assert parts.count() == 14
    got = Q.quantiles(Q.merged(parts), [0.01, 0.3, 0.5, 0.9]).collect()
    kept = {"a": np.sort(values), "b": np.sort([-float(i) for i in range(len(values)) if i % 3 == 0])}
    for r in got:
        v = kept[r.feature]
        assert r.n == len(v) and r.low == v[0] and r.high == v[-1]
        below, upto = np.searchsorted(v, r.quantile, "left") / len(v), np.searchsorted(v, r.quantile, "right") / len(v)
        assert below - 2 * Q.rank_error(400) <= r.prob <= upto + 2 * Q.rank_error(400)


def test_a_new_part_is_merged_with_stored_sketches(spark):
    one = Q.sketched(spark.range(1000).selectExpr("cast(id AS double) AS a", "'x' AS part"), ["a"], "part")
    two = Q.sketched(spark.range(1000, 3000).selectExpr("cast(id AS double) AS a", "'y' AS part"), ["a"], "part")
    [r] = Q.quantiles(Q.merged(one.unionByName(two)), [0.5]).collect()
    assert r.n == 3000 and abs(r.quantile - 1500) <= 3000 * 2 * Q.rank_error(800)


def test_missing_values(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (None, None), (3.0, float("nan"))], "a double, b double")
    got = {r.feature: r for r in Q.describe_sketched(df, ["a", "b"]).collect()}
    assert (got["a"]["count"], got["a"]["mean"], got["a"]["min"], got["a"]["max"]) == (2, 2.0, 1.0, 3.0) and got["a"].q25 == 1.0
    assert got["b"]["count"] == 0 and got["b"].q50 is None and got["b"]["mean"] is None


def test_sketches_shuffle_no_values(spark):
    plan = Q.describe_sketched(spark.range(10_000).selectExpr("cast(id AS double) AS a"), ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "Sort " not in plan and "RangePartitioning" not in plan


@pytest.fixture
def no_broadcast(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_bucketed_artifacts_are_joined_without_a_shuffle(spark, no_broadcast):
    ids = spark.range(500).selectExpr("'s' AS split", "cast(id % 5 AS string) AS fold", "42 AS seed", "id AS row_id", "id * 1.0D AS y_true", "id * 2.0D AS y_pred", "concat('k', id % 7) AS key")
    keys = ["split", "fold", "row_id"]
    art = write_bucketed(ids.select("row_id", "key"), ["row_id"], 8)
    cur = write_bucketed(ids.selectExpr("row_id", "if(row_id % 100 = 0, 'other', key) AS key"), ["row_id"], 8)
    wrong = E.misaligned(art, cur, "row_id", "key")
    assert exchanges(wrong) == 0 and wrong.count() == 5
    train = write_bucketed(ids.select(keys), keys, 8)
    subset = write_bucketed(ids.where("row_id % 2 = 0").selectExpr(*keys, "'dedup' AS arm"), keys, 8)
    cut = E.apply_subset(train, subset, "dedup")
    assert exchanges(cut) == 0 and cut.count() == 250
    on = ["split", "fold", "seed", "row_id"]
    models = {m: write_bucketed(ids.select(*on, "y_true", "y_pred"), on, 8) for m in ("a", "b", "c")}
    joined = E.join_predictions(models)
    assert exchanges(joined) == 0 and joined.count() == 500
    # the same tables as plain files are shuffled
    assert exchanges(E.misaligned(settle(art, "plain"), settle(cur, "plain"), "row_id", "key")) > 0


def test_buckets_of_another_session_are_attached(spark, no_broadcast):
    path = new_table_path(spark, "buckets")
    write_bucketed(spark.range(100).selectExpr("id", "id * 2 AS v"), ["id"], 8, path=path)
    again = attach(spark, "attached_artifact", path, "id bigint, v bigint", ["id"], 8)
    assert exchanges(again.join(again.withColumnRenamed("v", "w"), "id")) == 0 and again.agg({"v": "sum"}).first()[0] == 9900


def test_bucket_numbers_grow_with_the_rows():
    assert [buckets_for(n) for n in (0, 8_000_000, 8_000_001, 10**9)] == [8, 8, 16, 1024]
