"""Elastic nets of a whole sweep from one pass of cross products.

A linear fit needs its rows only through the sums of their products. One scan adds them up for each fold and for each
validation draw; the training side of a fit is the sum over the other folds less its draw. The fits, one for
each (fold, seed), are then solved from their sums by the executors, all penalties of a fit in one go, and one more narrow pass
predicts. The number of Spark jobs does not depend on the number of fits.

The penalty acts on standardised features: with w a coefficient in units of the target a standard deviation, a fit minimises
``|y - Xw|^2 / 2n + reg * (mix * |w|_1 + (1 - mix) / 2 * |w|^2)``. A feature without spread has coefficient 0; rows with a missing
target or feature are left out of fits and have no prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.operators.ranking import draw_cutoffs
from assayframe.sources.session import settle

FITTED = "reg double, mix double, intercept double, coef array<double>"


# --- from sums to coefficients ----------------------------------------------------------------


def solve(sums: np.ndarray, penalties: list[tuple[float, float]], origin: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """Intercept and coefficients for each (reg, mix), from the sums of products of (1, y, x..), y and x less ``origin``."""
    p = len(sums) - 2
    n = sums[0, 0]
    if n <= 0:
        return [(float("nan"), np.full(p, np.nan)) for _ in penalties]
    mean = sums[0] / n
    cov = sums / n - np.outer(mean, mean)
    power = np.diag(sums)[2:] / n
    var = np.diag(cov)[2:]
    sd = np.sqrt(np.where(var <= 1e-13 * power, 0.0, var))
    use = np.flatnonzero(sd > 0)
    corr = cov[2:, 2:][np.ix_(use, use)] / np.outer(sd[use], sd[use])
    to_y = cov[1, 2:][use] / sd[use]
    out, w = [], np.zeros(len(use))
    for reg, mix in penalties:
        w = descend(corr, to_y, reg, mix, w)
        coef = np.zeros(p)
        coef[use] = w / sd[use]
        out.append((float(mean[1] + origin[0] - coef @ (mean[2:] + origin[1:])), coef))
    return out


def descend(corr: np.ndarray, to_y: np.ndarray, reg: float, mix: float, start: np.ndarray, sweeps: int = 20_000) -> np.ndarray:
    """Minimum of w'Cw/2 - c'w + reg * (mix * |w|_1 + (1 - mix)/2 * |w|^2): closed without an absolute part, else by
    coordinates until none moves by more than 1e-13 of the largest."""
    if not len(to_y):
        return np.zeros(0)
    if reg * mix == 0:
        return np.linalg.lstsq(corr + reg * np.eye(len(to_y)), to_y, rcond=None)[0]
    w, bound, ridge = start.copy(), reg * mix, 1 + reg * (1 - mix)
    rest = to_y - corr @ w
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(w)):
            pull = rest[j] + w[j]  # the diagonal is 1
            new = np.sign(pull) * max(abs(pull) - bound, 0.0) / ridge
            step = new - w[j]
            if step:
                rest -= corr[:, j] * step
                w[j] = new
                most = max(most, abs(step))
        if most <= 1e-13 * max(np.abs(w).max(), 1e-300):
            break
    return w


# --- sums -------------------------------------------------------------------------------------


def cross_products(rows: DataFrame, target: Column, features: list[str], units: Column, origin: np.ndarray) -> DataFrame:
    """(unit, i, j, v): sums of the products of (1, y, x..) over the rows of each unit; ``units`` is an array, so a row may be in
    several. Each task sends one triangle a unit."""
    p = len(features)

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            z = np.column_stack([np.ones(batch.num_rows), *[batch.column(f"z{k}").to_numpy(zero_copy_only=False) for k in range(p + 1)]])
            z[:, 1:] -= origin
            lists = batch.column("units")
            unit = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            order = np.argsort(unit, kind="stable")
            unit, row = unit[order], row[order]
            cuts = np.flatnonzero(np.diff(unit, prepend=-1))
            for u, of in zip(unit[cuts].tolist(), np.split(row, cuts[1:])):
                part = z[of].T @ z[of]
                sums[u] = part if u not in sums else sums[u] + part
        upper = np.triu_indices(p + 2)
        for u, m in sums.items():
            arrays = [np.full(len(upper[0]), u, np.int32), upper[0].astype(np.int32), upper[1].astype(np.int32), m[upper]]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["unit", "i", "j", "v"])

    numbers = [target.cast("double").alias("z0"), *[F.col(f"`{f}`").cast("double").alias(f"z{k + 1}") for k, f in enumerate(features)]]
    flat = rows.select(*numbers, units.cast("array<int>").alias("units")).na.drop()
    flat = flat.where(~_any([F.isnan(f"z{k}") for k in range(p + 1)]))
    parts = flat.mapInArrow(accumulate, "unit int, i int, j int, v double")
    return parts.groupBy("unit", "i", "j").agg(F.sum("v").alias("v"))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def fitted(signed: DataFrame, keys: list[str], penalties: list[tuple[float, float]], p: int, origin: np.ndarray) -> DataFrame:
    """One row for each fit (``keys``) and penalty, from (keys, i, j, v) whose sums are the fit's cross products."""
    kinds = [f"{k} {signed.schema[k].dataType.simpleString()}" for k in keys]

    def one(part: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((p + 2, p + 2))
        m[part["i"], part["j"]] = m[part["j"], part["i"]] = part["v"]
        found = solve(m, penalties, origin)
        head = {k: [part[k].iloc[0]] * len(penalties) for k in keys}
        regs, mixes = zip(*penalties)
        return pd.DataFrame({**head, "reg": regs, "mix": mixes, "intercept": [a for a, _ in found], "coef": [b.tolist() for _, b in found]})

    sums = signed.groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))
    return sums.groupBy(*keys).applyInPandas(one, ", ".join([*kinds, FITTED]))


def predicted(features: list[str]) -> Column:
    """Prediction from the columns of a fit; summed in order of the features."""
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    return F.aggregate(F.zip_with(x, "coef", lambda a, b: a * b), F.col("intercept"), lambda s, v: s + v)


def _origin(low: dict, features: list[str]) -> np.ndarray:
    return np.array([0.0 if low.get(k) is None else float(low[k]) for k in ["_y", *[f"_x{i}" for i in range(len(features))]]])


def _lows(target: Column, features: list[str]) -> list[Column]:
    """Any fixed value near the data serves as origin; the minimum keeps constants exact."""
    low = lambda c: F.min(F.nanvl(c.cast("double"), F.lit(None).cast("double")))
    return [low(target).alias("_y"), *[low(F.col(f"`{f}`")).alias(f"_x{i}") for i, f in enumerate(features)]]


def _target(name: str, log_target: bool) -> Column:
    y = F.col(f"`{name}`").cast("double")
    return F.log1p(y) if log_target else y


# --- sweeps -----------------------------------------------------------------------------------


def validation_draws(rows: DataFrame, fold: str, row_id: str, sizes: dict, seeds: list[int]) -> list[dict]:
    """For each (fold, seed) the last (hash, row_id) of its validation side: a tenth of the rows of all other folds, rounded down
    and at least one. All draws are cut by the same jobs."""
    spark = rows.sparkSession
    total = sum(sizes.values())
    wanted = [(f, s, "val", max(1, (total - n) // 10)) for f, n in sizes.items() if f is not None for s in seeds]
    kind = rows.schema[fold].dataType.simpleString()
    quotas = spark.createDataFrame(wanted, f"f {kind}, s int, tag string, take long")  # one row a fit
    fits = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(s).alias("s")) for f, s, _, _ in wanted])
    long = rows.select(F.col(row_id).alias("row_id"), F.col(fold).alias("own"), F.inline(fits)).where(~F.col("own").eqNullSafe(F.col("f")))
    drawn = long.select("f", "s", "row_id", _draw(F.col("s"), F.col("f"), F.col("row_id")).alias("h"))
    return [r.asDict() for r in draw_cutoffs(drawn, quotas, ["f", "s"]).collect()]


def _draw(seed: Column, fold: Column, row_id: Column) -> Column:
    return F.md5(F.concat_ws(":", seed.cast("string"), F.concat(F.lit("val/"), fold.cast("string")), row_id.cast("string")))


def elastic_sweep(
    df: DataFrame, target: str, features: list[str], seeds: list[int], penalties: list[tuple[float, float]], fold: str = "fold",
    row_id: str = "row_id", log_target: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Predictions (fold, seed, reg, mix, row_id, y_true, y_pred) of every fold's rows by the fits on all other folds less a validation draw,
    and the fits (fold, seed, reg, mix, intercept, coef). Rows without a fold train every fit."""
    y = _target(target, log_target)
    facts = df.groupBy(F.col(fold).alias("_f")).agg(F.count(F.lit(1)).alias("_n"), *_lows(y, features)).collect()  # one row a fold
    sizes = {r["_f"]: r["_n"] for r in facts}
    names = ["_y", *[f"_x{i}" for i in range(len(features))]]
    origin = _origin({k: min((r[k] for r in facts if r[k] is not None), default=None) for k in names}, features)
    draws = validation_draws(df, fold, row_id, sizes, seeds)
    folds = sorted(f for f in sizes if f is not None)

    # units: a fold each, one for rows without, and a validation draw each
    cut = F.array(
        *[
            F.struct(F.lit(len(folds) + 1 + k).alias("u"), F.lit(d["f"]).alias("f"), F.lit(d["s"]).alias("s"), F.lit(d["cut_h"]).alias("h"), F.lit(d["cut_id"]).alias("i"))
            for k, d in enumerate(draws)
        ]
    )
    own = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, f in enumerate(folds) for x in (f, k)]), F.col(fold)), F.lit(len(folds)))

    def inside(c: Column) -> Column:
        drawn = F.struct(_draw(c["s"], c["f"], F.col(row_id)).alias("h"), F.col(row_id).alias("i"))
        return ~F.col(fold).eqNullSafe(c["f"]) & (drawn <= F.struct(c["h"].alias("h"), c["i"].alias("i")))

    units = F.concat(F.array(own), F.transform(F.filter(cut, inside), lambda c: c["u"]))
    sums = settle(cross_products(df, y, features, units, origin), "sweep-sums")

    # what each fit adds and takes away
    spark = df.sparkSession
    rows = []
    for k, d in enumerate(draws):
        rows += [(d["f"], d["s"], u, 1) for u, f in enumerate([*folds, None]) if f != d["f"]] + [(d["f"], d["s"], len(folds) + 1 + k, -1)]
    parts = spark.createDataFrame(rows, f"fold {df.schema[fold].dataType.simpleString()}, seed int, unit int, sign int")
    signed = sums.join(F.broadcast(parts), "unit").select("fold", "seed", "i", "j", (F.col("v") * F.col("sign")).alias("v"))
    fits = settle(fitted(signed, ["fold", "seed"], penalties, len(features), origin), "sweep-fits")
    told = predicted(features)
    narrow = df.select(F.col(fold).alias("fold"), F.col(row_id).alias(row_id), F.col(f"`{target}`").alias("y_true"), *[F.col(f"`{f}`") for f in features if f not in (fold, row_id)])
    out = narrow.join(fits, "fold").select("fold", "seed", "reg", "mix", row_id, "y_true", (F.expm1(told) if log_target else told).alias("y_pred"))
    return out, fits


def elastic_grid(
    df: DataFrame, target: str, features: list[str], reg: tuple[float, ...], mix: tuple[float, ...], role: str = "role", log_target: bool = False
) -> DataFrame:
    """(reg, mix, val_mae): error on role val of every grid point fitted on role train, best first (of equals the first in the grid). One scan
    for the sums and one for the errors, whatever the grid."""
    y = _target(target, log_target)
    grid = [(float(r), float(m)) for r in reg for m in mix]
    train, val = df.where(F.col(role) == "train"), df.where(F.col(role) == "val")
    origin = _origin(train.agg(*_lows(y, features)).first().asDict(), features)
    sums = cross_products(train, y, features, F.array(F.lit(0)), origin)
    fits = fitted(sums.withColumnRenamed("unit", "fit"), ["fit"], grid, len(features), origin).collect()  # one row a grid point
    at = {(f["reg"], f["mix"]): f for f in fits}
    if not at:
        return df.sparkSession.createDataFrame([], "reg double, mix double, val_mae double")
    a = np.array([at[g]["intercept"] for g in grid])
    b = np.array([at[g]["coef"] for g in grid])

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(grid)), 0
        for batch in batches:
            x = np.column_stack([batch.column(f"x{k}").to_numpy(zero_copy_only=False) for k in range(len(features))])
            told = a + x @ b.T
            told = np.expm1(told) if log_target else told
            total += np.abs(batch.column("y").to_numpy(zero_copy_only=False)[:, None] - told).sum(axis=0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(grid), dtype=np.int32)), pa.array(total), pa.array(np.full(len(grid), n))], ["g", "e", "n"])

    numbers = [F.col(f"`{target}`").cast("double").alias("y"), *[F.col(f"`{f}`").cast("double").alias(f"x{k}") for k, f in enumerate(features)]]
    flat = val.select(*numbers).na.drop()
    flat = flat.where(~_any([F.isnan(c) for c in flat.columns]))
    found = flat.mapInArrow(errors, "g int, e double, n long").groupBy("g").agg(F.sum("e").alias("e"), F.sum("n").alias("n")).collect()
    rows = [(*grid[r["g"]], r["e"] / r["n"] if r["n"] else None) for r in sorted(found, key=lambda r: r["g"])]
    rows.sort(key=lambda r: (r[2] is None, r[2]))
    return df.sparkSession.createDataFrame(rows, "reg double, mix double, val_mae double")
