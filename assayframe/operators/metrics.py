"""Error metrics and their summaries. Every metric of a grouping comes from one
pass of partial aggregates, so a hot group costs no more than a cold one."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions.draws import hash_int
from assayframe.functions.numeric import r_squared, ratio
from assayframe.sources.session import settle

PREDICTION_BOUND = 100.0
# The metrics of a summary.
SUMMARY_METRICS = ("mae", "rmse", "r2", "mrae", "mae_nonmetals", "rmse_nonmetals", "r2_nonmetals")


def evaluate(df: DataFrame, keys: list[str], y: str = "y_true", p: str = "y_pred", extra: list[Column] | None = None) -> DataFrame:
    """Errors per key: n_test, mae, rmse, r2, mrae, mape, the variants over non-zero
    targets (NULL below two such rows) and the divergence flag.

    Rows without a truth (NULL or NaN) count for nothing. A group with a missing or non-finite
    prediction for a known truth is flagged and has NULL metrics.
    """
    yt, yp = F.nanvl(F.col(y).cast("double"), F.lit(None).cast("double")), F.col(p).cast("double")
    known = yt.isNotNull()
    bad = known & (F.coalesce(F.isnan(yp) | (F.abs(yp) == float("inf")), F.lit(True)) | yp.isNull())
    ok = known & ~bad
    nz = yt != 0
    err = yp - yt
    cond_err = F.when(ok, err)
    aggs = [
        F.count_if(known).alias("n_test"),
        F.count_if(bad).alias("_bad"),
        F.avg(F.abs(cond_err)).alias("_mae"),
        F.sum(cond_err * cond_err).alias("_sse"),
        F.var_pop(yt).alias("_var"),
        F.count_if(nz).alias("_nz"),
        F.avg(F.when(nz, F.abs(cond_err))).alias("_mae_nz"),
        F.sum(F.when(nz, cond_err * cond_err)).alias("_sse_nz"),
        F.var_pop(F.when(nz, yt)).alias("_var_nz"),
        F.avg(F.when(nz, F.abs(cond_err) / F.nullif(F.abs(yt), F.lit(0.0)))).alias("_mrae"),
        F.max(F.abs(F.when(ok, yp))).alias("max_abs_pred"),
    ]
    g = df.groupBy(*keys).agg(*aggs, *(extra or []))
    clean = F.col("_bad") == 0
    two = clean & (F.col("_nz") >= 2)
    n, nnz = F.col("n_test"), F.col("_nz")
    r2 = F.when(clean, r_squared(n, F.col("_sse"), F.col("_var") * n))
    kept = [c for c in g.columns if not c.startswith("_") and c not in (*keys, "n_test", "max_abs_pred")]
    return g.select(
        *keys,
        "n_test",
        F.when(clean, F.col("_mae")).alias("mae"),
        F.when(clean, F.sqrt(ratio(F.col("_sse"), n))).alias("rmse"),
        r2.alias("r2"),
        F.when(clean, F.col("_mrae")).alias("mrae"),
        F.when(clean, F.col("_mrae") * 100).alias("mape"),
        F.when(two, F.col("_mae_nz")).alias("mae_nonmetals"),
        F.when(two, F.sqrt(ratio(F.col("_sse_nz"), nnz))).alias("rmse_nonmetals"),
        F.when(two, r_squared(nnz, F.col("_sse_nz"), F.col("_var_nz") * nnz)).alias("r2_nonmetals"),
        (~clean | r2.isNull() | (r2 < 0) | (F.col("max_abs_pred") > PREDICTION_BOUND)).alias("diverged"),
        "max_abs_pred",
        *kept,
    )


def evaluate_by_group(df: DataFrame, group: str, min_samples: int = 5, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Metrics per non-NULL group of at least ``min_samples`` rows."""
    out = evaluate(df.where(F.col(group).isNotNull()), [group], y, p).where(F.col("n_test") >= min_samples)
    return out.withColumnRenamed(group, "class")


def split_summary(fold_metrics: DataFrame, metrics: tuple[str, ...] = SUMMARY_METRICS) -> DataFrame:
    """Rows, mean and sample std of each metric per split."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return fold_metrics.groupBy("split").agg(*aggs)


def bootstrap_ci(
    df: DataFrame, key: str, value: str, order: list[str], n_boot: int = 2000, ci: float = 0.95, seed: int = 42
) -> DataFrame:
    """Percentile bootstrap interval of the mean per key: key, n, ci_lo, ci_hi.

    ``df`` holds metric values (one per fold and seed), numbered per key along
    ``order``. Replicates are rows spread over the cluster before their draws are
    made, and each draw picks position md5(seed:key:replicate:draw) mod n. Fewer
    than two values give NULLs.
    """
    from pyspark.sql import Window

    vals = df.where(F.col(value).isNotNull()).select(
        F.col(key).cast("string").alias(key),
        F.col(value).alias("_v"),
        (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("bigint").alias("_i"),
    )
    vals = settle(vals, "boot-values")
    sizes = vals.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    reps = sizes.where("n >= 2").select(key, "n", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("_rep"))
    reps = reps.repartition(key, "_rep")
    draws = reps.select(key, "n", "_rep", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_draw"))
    spot = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key), F.col("_rep").cast("string"), F.col("_draw").cast("string")))
    draws = draws.withColumn("_i", F.pmod(hash_int(spot), F.col("n")))
    means = draws.join(vals, [key, "_i"]).groupBy(key, "_rep").agg(F.avg("_v").alias("_mean"))
    lo, hi = (1 - ci) / 2, (1 + ci) / 2
    # percentile() keeps the distinct values of a key in one buffer: n_boot of them at most.
    bounds = means.groupBy(key).agg(
        F.percentile("_mean", F.lit(lo)).alias("ci_lo"), F.percentile("_mean", F.lit(hi)).alias("ci_hi")
    )
    return sizes.join(bounds, key, "left").select(key, "n", "ci_lo", "ci_hi")


def bootstrap_ci_large(
    df: DataFrame, key: str, value: str, row_id: str, n_boot: int = 200, ci: float = 0.95, seed: int = 42
) -> DataFrame:
    """Percentile bootstrap interval of the mean per key for any number of rows: key, n, ci_lo, ci_hi.

    Each row enters each replicate as often as a Poisson draw of mean 1 says, which is what drawing with replacement comes
    to for many rows. Draws depend on (seed, row_id, replicate) alone, so partitioning does not matter; tasks send
    one pair of sums a key and replicate. Fewer than two values give NULLs.
    """
    edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])

    def add_up(batches):
        sums: dict[str, np.ndarray] = {}
        turns = np.arange(1, n_boot + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for pdf in batches:
            for at in range(0, len(pdf), 2_000):
                part = pdf.iloc[at : at + 2_000]
                x = part["h"].to_numpy(np.int64).view(np.uint64)[:, None] ^ turns[None, :]
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
                weight = np.searchsorted(edges, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, side="right")
                for name, rows in part.groupby("k", sort=False).indices.items():
                    own = np.stack((weight[rows].sum(0), part["v"].to_numpy()[rows] @ weight[rows]))
                    sums[name] = own if name not in sums else sums[name] + own
        for name, own in sums.items():
            yield pd.DataFrame({"k": name, "rep": np.arange(n_boot), "w": own[0], "wv": own[1]})

    rows = df.where(F.col(value).isNotNull()).select(
        F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("v"), F.xxhash64(F.lit(seed), F.col(row_id)).alias("h")
    )
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    reps = rows.mapInPandas(add_up, "k string, rep int, w double, wv double").groupBy("k", "rep").agg(ratio(F.sum("wv"), F.sum("w")).alias("m"))
    lo, hi = (1 - ci) / 2, (1 + ci) / 2
    # n_boot means a key at most
    bounds = reps.groupBy("k").agg(F.percentile("m", F.lit(lo)).alias("ci_lo"), F.percentile("m", F.lit(hi)).alias("ci_hi"))
    two = F.col("n") >= 2
    return sizes.join(bounds, "k", "left").select(
        F.col("k").alias(key), "n", F.when(two, F.col("ci_lo")).alias("ci_lo"), F.when(two, F.col("ci_hi")).alias("ci_hi")
    )


def fold_means(fold_metrics: DataFrame, by: str = "fold", metric: str = "mae") -> DataFrame:
    return fold_metrics.groupBy(by).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))


def extrapolation_penalty(
    fold_metrics: DataFrame, metric: str = "mae",
    names: tuple[str, str, str] = ("extrapolation", "inrange_control", "random_control"),
) -> DataFrame:
    """Fold means plus the two penalties, each present only when both folds are:
    against the in-range control, and (naive) against the random control."""
    ext, inr, rnd = names
    means = fold_means(fold_metrics, "fold", metric)
    pick = lambda f: F.avg(F.when(F.col("fold") == f, F.col(metric)))
    gap = fold_metrics.agg(
        (pick(ext) - pick(inr)).alias("penalty_vs_inrange"), (pick(ext) - pick(rnd)).alias("penalty_vs_random")
    ).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("fold"), F.col(n).alias("mean"), F.lit(None).cast("double").alias("std"))
                    for n in ("penalty_vs_inrange", "penalty_vs_random")
                ]
            )
        )
    )
    return means.unionByName(gap.where(F.col("mean").isNotNull()))


# The contrasts between training arms.
CONTRASTS = {"total": ("full", "dedup"), "volume": ("full", "sizematched"), "redundancy": ("sizematched", "dedup")}
ARM_ORDER = ("full", "dedup", "sizematched")


def paired_deltas(results: DataFrame, metric: str = "mae", contrasts: dict | None = None) -> DataFrame:
    """Seed-paired difference between arms per model: (model, contrast, mean_delta, std_delta, n_seeds).

    One pivot per (model, seed) serves every contrast; only seeds with both arms count.
    """
    contrasts = contrasts or CONTRASTS
    arms = sorted({a for pair in contrasts.values() for a in pair})
    wide = results.groupBy("model", "seed").agg(
        *[F.max(F.when(F.col("arm") == a, F.col(metric))).alias(f"_{a}") for a in arms]
    )
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("contrast"), (F.col(f"_{a}") - F.col(f"_{b}")).alias("_d"))
            for name, (a, b) in contrasts.items()
        ]
    )
    flat = wide.select("model", "seed", F.inline(rows)).where(F.col("_d").isNotNull())
    return flat.groupBy("model", "contrast").agg(
        F.avg("_d").alias("mean_delta"), F.stddev_samp("_d").alias("std_delta"), F.count(F.lit(1)).alias("n_seeds")
    )


def arm_table(results: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and std per model and arm, with the fixed arm position for ordering."""
    pos = F.array_position(F.array(*[F.lit(a) for a in ARM_ORDER]), F.col("arm"))
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return results.groupBy("model", "arm").agg(*aggs).withColumn("position", pos.cast("bigint"))


def nonredundant_mae(df: DataFrame, keys: list[str], flag: str, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """MAE over the test rows flagged as survivors of de-duplication."""
    err = F.abs(F.col(p) - F.col(y))
    return df.groupBy(*keys).agg(
        F.avg(err).alias("mae"),
        F.avg(F.when(F.col(flag), err)).alias("mae_test_nonredundant"),
        F.count_if(F.col(flag)).alias("n_survivors"),
    )


def best_epochs(curves: DataFrame, run: list[str], epoch: str, value: str) -> DataFrame:
    """Epochs of the lowest value per run, the first and the last of them, from one grouping."""
    found = [F.min_by(epoch, F.struct(F.col(value), side)) for side in (F.col(epoch), -F.col(epoch))]
    known = curves.where(F.col(value).isNotNull())
    return known.groupBy(*run).agg(found[0].alias("best_earliest"), found[1].alias("best_latest"), F.min(value).alias("best_value"))


def best_epoch(curves: DataFrame, run: list[str], epoch: str, value: str, ties: str = "earliest") -> DataFrame:
    """Epoch of the lowest value per run; ``ties`` is earliest (strict <) or latest (<=)."""
    return best_epochs(curves, run, epoch, value).select(*run, F.col(f"best_{ties}").alias("best_epoch"), "best_value")


def long_curves(df: DataFrame, run: list[str], series: dict[tuple[str, str], str]) -> DataFrame:
    """Array columns to rows: run, dataset, metric, step (1-based), value.

    ``series`` maps (dataset, metric) to an array column; a series of one point is no curve.
    """
    tagged = F.array(
        *[
            F.struct(F.lit(d).alias("dataset"), F.lit(m).alias("metric"), F.col(c).cast("array<double>").alias("_s"))
            for (d, m), c in series.items()
        ]
    )
    flat = df.select(*run, F.inline(tagged)).where(F.size("_s") > 1)
    return flat.select(*run, "dataset", "metric", F.posexplode("_s").alias("step", "value")).withColumn(
        "step", (F.col("step") + 1).cast("bigint")
    )


def missing_units(expected: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    return expected.select(*on).distinct().join(present.select(*on).distinct(), on, "left_anti")


def publish_if_complete(expected: DataFrame, results: DataFrame, on: list[str]) -> tuple[DataFrame | None, DataFrame]:
    """(results, missing): the results only when every expected unit has one."""
    missing = settle(missing_units(expected, results, on), "missing")
    return (results if missing.isEmpty() else None), missing


def compare_datasets(frames: dict[str, DataFrame], y: str = "y_true", p: str = "y_pred", role: str = "role") -> DataFrame:
    """One row per dataset variant: n_train, n_test, mae, rmse, r2, mape (errors on test rows)."""
    tagged = None
    for name, df in frames.items():
        part = df.select(F.lit(name).alias("dataset"), F.col(role).alias("role"), F.col(y).alias("y_true"), F.col(p).alias("y_pred"))
        tagged = part if tagged is None else tagged.unionByName(part)
    n_train = tagged.groupBy("dataset").agg(F.count_if(F.col("role") == "train").alias("n_train"))
    scored = evaluate(tagged.where(F.col("role") == "test"), ["dataset"]).select("dataset", "n_test", "mae", "rmse", "r2", "mape")
    return n_train.join(scored, "dataset", "left")
