"""Fold-parallel evaluation with MLlib estimators."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions.draws import draw_hash
from assayframe.operators.ranking import draw_cutoffs
from assayframe.sources.session import release, settle


def assemble(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns plus the feature vector ``x``."""
    return VectorAssembler(inputCols=features, outputCol="x").transform(df).select(*keep, "x")


def boosted_trees(
    df: DataFrame, target: str, features: list[str], role: str = "role", seed: int = 42,
    max_iter: int = 20, depth: int = 4, log_target: bool = False, curves: bool = False,
) -> tuple[DataFrame, dict]:
    """Fit on role train, stop early on role val, predict role test.

    ``df`` has the vector ``x``. With ``log_target`` the fit sees log1p of the target and
    predictions are mapped back by expm1, without clamping. Returns the predictions and
    the fitted facts (trees used, importances and, on request, the error after each tree
    on both sides of the fit).
    """
    y = F.log1p(F.col(target).cast("double")) if log_target else F.col(target).cast("double")
    fit_rows = df.where(F.col(role).isin("train", "val")).select(y.alias("_y"), "x", (F.col(role) == "val").alias("_val"))
    est = GBTRegressor(
        featuresCol="x", labelCol="_y", predictionCol="_p", maxIter=max_iter, maxDepth=depth, seed=seed,
        validationIndicatorCol="_val",
    )
    model = est.fit(fit_rows)
    pred = F.expm1("_p") if log_target else F.col("_p")
    out = model.transform(df.where(F.col(role) == "test")).withColumn("y_pred", pred).drop("_p")
    facts = {
        "n_trees": int(model.getNumTrees), "n_estimators": max_iter, "seed": seed,
        "importance": {f: float(v) for f, v in zip(features, model.featureImportances.toArray())},
    }
    if curves:
        facts["curves"] = {
            (name, metric): model.evaluateEachIteration(fit_rows.where(F.col("_val") == val), loss)
            for name, val in (("train", False), ("val", True)) for metric, loss in (("mae", "absolute"), ("mse", "squared"))
        }
    return out, facts


def importance_rows(spark, facts: dict) -> DataFrame:
    """Importances as rows (seed, feature, importance)."""
    rows = [(facts["seed"], f, v) for f, v in facts["importance"].items()]
    return spark.createDataFrame(rows, "seed int, feature string, importance double")


def curve_rows(spark, facts: dict) -> DataFrame:
    """Error after each tree as rows (seed, dataset, n_trees, metric, value)."""
    rows = [
        (facts["seed"], part, i + 1, metric, float(v))
        for (part, metric), series in facts["curves"].items() for i, v in enumerate(series)
    ]
    return spark.createDataFrame(rows, "seed int, dataset string, n_trees int, metric string, value double")


def least_squares(df: DataFrame, target: str, features: list[str], role: str = "role", seed: int = 42, log_target: bool = False) -> tuple[DataFrame, dict]:
    """Ordinary least squares on role train, predicting role test; like ``boosted_trees`` otherwise."""
    y = F.log1p(F.col(target).cast("double")) if log_target else F.col(target).cast("double")
    est = LinearRegression(featuresCol="x", labelCol="_y", predictionCol="_p", solver="normal")
    model = est.fit(df.where(F.col(role) == "train").select(y.alias("_y"), "x"))
    pred = F.expm1("_p") if log_target else F.col("_p")
    out = model.transform(df.where(F.col(role) == "test")).withColumn("y_pred", pred).drop("_p")
    return out, {"seed": seed, "coefficients": dict(zip(features, model.coefficients.toArray().tolist())), "intercept": model.intercept}


def _is_test(fold_col: str, fold) -> Column:
    return F.col(fold_col).eqNullSafe(F.lit(fold))


def _validation_sides(base: DataFrame, fold_col: str, cases: list[tuple], quotas: list[int]) -> list[Column]:
    """For each (fold, seed) a boolean ``_val<number>``: is the row among the first ``quotas`` draws outside the fold?"""
    if not cases:
        return []
    spark = base.sparkSession
    draw = lambda k: draw_hash(cases[k][1], f"val/{cases[k][0]}", "row_id")
    one = lambda k: F.when(~_is_test(fold_col, cases[k][0]), F.struct(F.lit(k).alias("case"), draw(k).alias("h")))
    drawn = base.select("row_id", F.explode(F.array(*[one(k) for k in range(len(cases))])).alias("_d")).where("_d IS NOT NULL")
    wanted = spark.createDataFrame([(k, "val", n) for k, n in enumerate(quotas)], "case int, tag string, take long")  # one row a fit
    cuts = draw_cutoffs(drawn.select("row_id", "_d.*"), wanted, ["case"])
    found = {r["case"]: r for r in cuts.collect()}  # one row a fit
    sides = []
    for k in range(len(cases)):
        bound = [F.lit(found[k]["cut_h"]).alias("h"), F.lit(found[k]["cut_id"]).alias("row_id")] if k in found else []
        inside = F.struct(draw(k).alias("h"), "row_id") <= F.struct(*bound) if bound else F.lit(False)
        sides.append(inside.alias(f"_val{k}"))
    return sides


def sweep(
    df: DataFrame, target: str, features: list[str], folds: list[str], seeds: list[int], fold_col: str = "fold", row_id: str = "row_id",
    estimator=boosted_trees, parallelism: int = 2, **kw,
) -> DataFrame:
    """Predictions (fold, seed, row_id, y_true, y_pred) over folds and seeds. Each fit is a
    distributed job; the driver only walks the short list of (fold, seed), ``parallelism`` fits at a time. A tenth of a
    fold's training rows, rounded down and at least one, is its validation side. The sides of all fits are
    drawn and written together, so that no pass of a fit repeats the draws.

    ``estimator`` takes (rows with x and role, target, features, seed=...) and returns (predictions with y_pred, facts)."""
    out = None
    base = settle(df, "sweep").withColumnRenamed(row_id, "row_id")
    sizes = {r["_f"]: r["n"] for r in base.groupBy(F.col(fold_col).alias("_f")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_rows = sum(sizes.values())
    cases = [(fold, seed) for fold in folds for seed in seeds]
    quotas = [max(1, (n_rows - sizes.get(fold, 0)) // 10) for fold, _ in cases]
    sided = settle(base.select("*", *_validation_sides(base, fold_col, cases, quotas)), "sweep-sides")
    release(base)

    def fitted(k: int) -> DataFrame:
        fold, seed = cases[k]
        role = F.when(_is_test(fold_col, fold), "test").when(F.col(f"_val{k}"), "val").otherwise("train")
        own = sided.withColumn("role", role).drop(*[f"_val{i}" for i in range(len(cases))])
        pred, _ = estimator(own, target, features, seed=seed, **kw)
        part = pred.select(
            F.lit(fold).alias("fold"), F.lit(seed).alias("seed"), "row_id", F.col(target).alias("y_true"), "y_pred"
        )
        return settle(part, "sweep-predictions")

    with ThreadPool(min(parallelism, len(cases)) or 1) as pool:
        for part in pool.map(inheritable_thread_target(base.sparkSession)(fitted), range(len(cases)), 1):
            out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("row_id", row_id)


def grid_search(df: DataFrame, target: str, role: str = "role", reg: tuple = (0.0, 0.1), mix: tuple = (0.0, 0.5), est=None) -> DataFrame:
    """Validation error of every grid point, fitted on role train only, best first (of equals the first in the grid).
    ``est`` is any linear estimator with regParam and elasticNetParam on the vector ``x``."""
    est = LinearRegression(featuresCol="x", labelCol=target) if est is None else est
    grid = ParamGridBuilder().addGrid(est.regParam, list(reg)).addGrid(est.elasticNetParam, list(mix)).build()
    train, val = settle(df.where(F.col(role) == "train"), "grid-train"), settle(df.where(F.col(role) == "val"), "grid-val")
    judge = RegressionEvaluator(labelCol=target, metricName="mae")
    rows = []
    for pt in grid:
        mae = judge.evaluate(est.fit(train, pt).transform(val))
        rows.append((float(pt[est.regParam]), float(pt[est.elasticNetParam]), float(mae)))
    rows.sort(key=lambda r: r[2])
    return df.sparkSession.createDataFrame(rows, "reg double, mix double, val_mae double")
