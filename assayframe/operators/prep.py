"""Train-only feature preparation: impute, drop, prune, scale.

Fitting needs two passes whatever the number of folds: exact medians from value
counts, and one pass of cross-product sums. Sums are kept per test fold, and the
training side of a fold is the total minus its own, so rows are never copied per
fold. Imputation is applied to the sums (the products of the missing-value
indicators are summed too), so no second data pass waits for the medians.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions.periodic import SYMBOLS
from assayframe.operators import wide
from assayframe.operators.ranking import exact_quantiles

CORR_LIMIT = 0.95


def protected_columns(names: list[str] | None) -> set[str]:
    """Columns named like an element; without names nothing is protected."""
    return set(names or ()) & set(SYMBOLS)


def number(name: str) -> Column:
    """A column as double, NaN as missing."""
    return F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(None).cast("double"))


@dataclass
class FittedPrep:
    """Statistics of one training side. ``kept`` features are scaled; the others were
    dropped for the reason in ``dropped``."""

    kept: list[str]
    median: dict[str, float]
    mean: dict[str, float]
    scale: dict[str, float]
    dropped: dict[str, str] = field(default_factory=dict)

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` columns plus the prepared features: one narrow projection."""
        cols = [
            ((F.coalesce(number(f), F.lit(self.median[f])) - self.mean[f]) / self.scale[f]).alias(f)
            for f in self.kept
        ]
        return df.select(*keep, *cols)

    def rows(self, fold: str) -> list[tuple]:
        out = [(fold, f, True, None, self.median[f], self.mean[f], self.scale[f]) for f in self.kept]
        return out + [(fold, f, False, why, self.median.get(f), None, None) for f, why in self.dropped.items()]


STATS_SCHEMA = "fold string, feature string, kept boolean, reason string, median double, mean double, scale double"


def stats_table(spark, fitted: dict[str, FittedPrep]) -> DataFrame:
    return spark.createDataFrame([r for f, p in fitted.items() for r in p.rows(f)], STATS_SCHEMA)


def _long(df: DataFrame, features: list[str], *keys: str) -> DataFrame:
    items = [F.struct(F.lit(f).alias("feature"), number(f).alias("value")) for f in features]
    return df.select(*keys, F.inline(F.array(*items))).where(F.col("value").isNotNull())


def medians(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, quantile): exact medians of one training side."""
    return exact_quantiles(_long(df, features), ["feature"], "value", [0.5])


def fold_medians(df: DataFrame, features: list[str], fold: str, labels: list[str]) -> DataFrame:
    """(fold, feature, quantile): exact medians of each fold's training side, the rows
    of the other folds. Values are counted first; only distinct values meet the fold list."""
    counts = _long(df, features, F.col(fold).alias("_own")).groupBy("feature", "value", "_own").agg(F.count(F.lit(1)).alias("_n"))
    per_value = counts.groupBy("feature", "value").agg(
        F.sum("_n").alias("_all"), F.map_from_entries(F.collect_list(F.struct("_own", "_n"))).alias("_by")
    )
    long = per_value.select(
        "feature", "value", F.explode(F.array(*[F.lit(x) for x in labels])).alias("fold"), "_all", "_by"
    ).select("feature", "value", "fold", (F.col("_all") - F.coalesce(F.try_element_at("_by", F.col("fold")), F.lit(0))).alias("w"))
    return exact_quantiles(long, ["fold", "feature"], "value", [0.5], weight="w")


def redundant(r: np.ndarray, to_target: np.ndarray, limit: float, safe: list[bool]) -> set[int]:
    """Columns to drop for the correlations ``r``: see ``wide.settle_pairs``."""
    return wide.settle_pairs(np.argwhere(np.triu(np.abs(r) > limit, 1)), to_target, safe)


def _finish(side: wide.Margins, gone: set[int], features: list[str], med: dict[str, float], origin: np.ndarray, safe: set[str]) -> FittedPrep:
    """Fitted statistics of one training side."""
    dropped, kept = {}, []
    for i, f in enumerate(features):
        if f not in med:
            dropped[f] = "all missing"
        elif not side.sd[i] > 0 and f not in safe:
            dropped[f] = "zero variance"
        elif i in gone:
            dropped[f] = "correlated"
        else:
            kept.append((i, f))
    return FittedPrep(
        kept=[f for _, f in kept],
        median=med,
        mean={f: float(side.mean[1 + i] + origin[1 + i]) for i, f in kept},
        scale={f: float(side.sd[i]) if side.sd[i] > 0 else 1.0 for i, f in kept},
        dropped=dropped,
    )


def fit_folds(
    df: DataFrame, features: list[str], target: str, fold: str | None = None, labels: list[str] | None = None,
    limit: float = CORR_LIMIT, names: list[str] | None = None, block: int = wide.BLOCK,
) -> dict[str, FittedPrep]:
    """Fit every fold's training side at once. Products are summed in blocks of ``block`` features, so the table may be wide: what reaches the
    driver is a few numbers a feature and fold.

    With ``fold``, a row is on the test side of its own fold and trains the others
    named in ``labels``; without it all rows train the single fold "all". ``names`` turns on
    the protection of element columns.
    """
    safe = protected_columns(names)
    rows = df.withColumn("_fold", F.coalesce(F.col(fold).cast("string"), F.lit("")) if fold else F.lit("none"))
    # Any fixed value near the data serves as origin; the minimum keeps constants exact.
    low = rows.agg(
        F.min(number(target)), *[F.min(number(f)) for f in features], *[F.count_if(number(f).isNull()) for f in features]
    ).first()
    p = len(features)
    origin = np.array([0.0 if v is None else float(v) for v in low[: p + 1]])
    layout = wide.Layout(p, [i for i, n in enumerate(low[p + 1 :]) if n], block)
    labels = ["all"] if fold is None else list(labels)
    med_rows = (
        medians(rows, features).withColumn("fold", F.lit("all")) if fold is None else fold_medians(rows, features, "_fold", labels)
    ).collect()
    med: dict[str, dict[str, float]] = {x: {} for x in labels}
    for r in med_rows:
        med[r["fold"]][r["feature"]] = float(r["quantile"])
    # imputing adds (median - origin) wherever a value is missing
    lifts = {x: np.array([med[x][f] - origin[1 + i] if f in med[x] else 0.0 for i, f in enumerate(features)]) for x in labels}
    sides, gone = wide.correlated(
        rows, number(target), [number(f) for f in features], layout, origin, lifts, limit, [f in safe for f in features], fold is not None
    )
    return {x: _finish(sides[x], gone[x], features, med[x], origin, safe) for x in labels}


def fit(df: DataFrame, features: list[str], target: str, limit: float = CORR_LIMIT, names: list[str] | None = None) -> FittedPrep:
    """Fit one training table."""
    return fit_folds(df, features, target, limit=limit, names=names)["all"]
