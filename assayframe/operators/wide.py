"""Cross products of wide feature tables in blocks, so that nothing of the size of a whole correlation matrix leaves the executors.

Features are cut into blocks of columns. One scan adds up, for each fold and pair of blocks, the products of their columns; a task
sends its sums when they fill its share of memory. A pair of blocks then meets the sums of all folds in one task, which
knows the mean and spread of every feature on each training side and lets through only the pairs of features above the limit. The pairs
of a fold are settled in one task, and one row a dropped feature reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.sources.session import Scratch

#: Features of a block.
BLOCK = 128

#: Bytes of sums that a task holds before it sends them.
HELD = 256 << 20

#: Rows that are multiplied at a time.
SLICE = 2_000


@dataclass
class Layout:
    """Columns of the products: 1, y, the features, and an indicator for each feature with gaps."""

    features: int
    gaps: list[int]
    block: int = BLOCK

    @property
    def width(self) -> int:
        return 2 + self.features + len(self.gaps)

    @property
    def blocks(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each block the features, and the columns of the products that belong to them (features, then indicators)."""
        at = {f: 2 + self.features + k for k, f in enumerate(self.gaps)}
        out = []
        for start in range(0, self.features, self.block):
            f = np.arange(start, min(start + self.block, self.features))
            out.append((f, np.concatenate((f + 2, np.array([at[i] for i in f.tolist() if i in at], np.int64)))))
        return out


def sums(rows: DataFrame, target: Column, features: list[Column], layout: Layout, origin: np.ndarray) -> DataFrame:
    """(fold, a, b, m) of rows with ``_fold``: products of the columns of blocks a <= b as float64 bytes, y and the features less ``origin`` and
    zero where missing; a = -1 holds the products of 1 and y with everything and the squares of the features."""
    blocks = [c for _, c in layout.blocks]
    p, many = layout.features, max(1, HELD // (8 * layout.width**2))

    def told(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for fold, m in held.items():
            rows = [(-1, -1, np.concatenate((m[:2].ravel(), np.diag(m))))]
            rows += [(a, b, m[np.ix_(blocks[a], blocks[b])].ravel()) for a in range(len(blocks)) for b in range(a, len(blocks))]
            for a, b, values in rows:  # a row at a time: a batch of blocks would be as large as the matrix
                yield pa.RecordBatch.from_arrays([pa.array([fold]), pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([values.tobytes()])], ["fold", "a", "b", "m"])

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                x = np.column_stack([part.column(f"z{k}").to_numpy(zero_copy_only=False) for k in range(p + 1)])
                missing = np.isnan(x[:, 1:])
                x = x - origin
                x[:, 1:][missing] = 0.0
                z = np.column_stack([np.ones(len(x)), x, missing[:, layout.gaps]])
                fold = part.column("fold").dictionary_encode()
                codes = fold.indices.to_numpy(zero_copy_only=False)
                for code, name in enumerate(fold.dictionary.to_pylist()):
                    own = z[codes == code]
                    if name not in held and len(held) >= many:
                        yield from told(held)
                        held = {}
                    product = own.T @ own
                    held[name] = product if name not in held else held[name] + product
        yield from told(held)

    numbers = [target.alias("z0"), *[f.alias(f"z{k + 1}") for k, f in enumerate(features)]]
    flat = rows.select(F.col("_fold").alias("fold"), *[F.coalesce(c, F.lit(float("nan"))) for c in numbers]).toDF("fold", *[f"z{k}" for k in range(p + 1)])
    return flat.where(~F.isnan("z0")).mapInArrow(accumulate, "fold string, a int, b int, m binary")


def _summed(part: pd.DataFrame) -> pd.DataFrame:
    total = np.frombuffer(part["m"].iloc[0], np.float64).copy()
    for m in part["m"].iloc[1:]:
        total += np.frombuffer(m, np.float64)
    return part.iloc[:1].assign(m=[total.tobytes()])[["fold", "a", "b", "m"]]


@dataclass
class Margins:
    """Statistics of one training side after imputation: rows, means of y and the features (less the origin), their standard deviations
    (0 where a feature does not vary), what a gap adds, and the relation of each feature to the target."""

    n: float
    mean: np.ndarray
    sd: np.ndarray
    lift: np.ndarray
    to_target: np.ndarray


def margins(edge: np.ndarray, layout: Layout, lift: np.ndarray) -> Margins:
    """From the products of 1 and y with everything and the squares, for what each gap adds to its feature."""
    p, w = layout.features, layout.width
    ones, with_y, squares = edge[:w], edge[w : 2 * w], edge[2 * w :]
    gap, gap_y = np.zeros(p), np.zeros(p)
    gap[layout.gaps], gap_y[layout.gaps] = ones[2 + p :], with_y[2 + p :]
    n = ones[0]
    if n <= 0:
        return Margins(0.0, np.zeros(p + 1), np.zeros(p), lift, np.zeros(p))
    mean = np.concatenate(([ones[1]], ones[2 : 2 + p] + lift * gap)) / n
    power = (squares[2 : 2 + p] + lift**2 * gap) / n  # a feature is 0 where its gap is 1
    var = power - mean[1:] ** 2
    sd = np.sqrt(np.where(var <= 1e-13 * power, 0.0, var))
    var_y = with_y[1] / n - mean[0] ** 2
    sd_y = np.sqrt(var_y if var_y > 1e-13 * with_y[1] / n else 0.0)
    cov = (with_y[2 : 2 + p] + lift * gap_y) / n - mean[0] * mean[1:]
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.round(cov / (sd * sd_y), 12)
    return Margins(n, mean, sd, lift, np.abs(np.where(np.isfinite(corr), corr, 0.0)))


def settle_pairs(pairs: np.ndarray, to_target: np.ndarray, safe: list[bool]) -> set[int]:
    """Columns to drop. The pairs are settled in order of (first, second) as long as both of a pair
    are still in: the one that ranks lower by (protected, relation to the target, earlier place) goes, unless it is protected."""
    still_in = np.ones(len(safe), bool)
    for pair in pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tolist():
        if still_in[pair].all():
            lower = min(pair, key=lambda c: (safe[c], to_target[c], -c))
            still_in[lower] = safe[lower]
    return set(np.flatnonzero(~still_in).tolist())


def correlated(
    rows: DataFrame, target: Column, features: list[Column], layout: Layout, origin: np.ndarray, lifts: dict[str, np.ndarray],
    limit: float, safe: list[bool], own_side: bool,
) -> tuple[dict[str, Margins], dict[str, set[int]]]:
    """For each training side (label, with what a gap adds to each feature) its margins and the features dropped for being
    correlated. With ``own_side`` a side is all rows but those whose ``_fold`` is its label, else all rows."""
    scratch = Scratch()
    parts = sums(rows, target, features, layout, origin)
    # the sums of a task meet those of the others in two steps, so that no group holds a row from every task
    spread = parts.withColumn("_t", F.spark_partition_id() % 32)
    first = spread.groupBy("fold", "a", "b", "_t").applyInPandas(_summed, "fold string, a int, b int, m binary")
    held = scratch.settle(first.groupBy("fold", "a", "b").applyInPandas(_summed, "fold string, a int, b int, m binary"), "block-sums")
    edges = {r["fold"]: np.frombuffer(r["m"], np.float64) for r in held.where("a = -1").collect()}  # a few numbers a feature and fold
    whole = sum(edges.values(), np.zeros(3 * layout.width))
    taken = lambda label: edges.get(label, 0.0) if own_side else 0.0
    sides = {label: margins(whole - taken(label), layout, lift) for label, lift in lifts.items()}
    blocks, gaps = layout.blocks, set(layout.gaps)

    def lifted(which: int, side: Margins) -> np.ndarray:
        """Adds the gaps of a block's features to them."""
        f, columns = blocks[which]
        out = np.zeros((len(f), len(columns)))
        out[np.arange(len(f)), np.arange(len(f))] = 1.0
        k = len(f)
        for row, i in enumerate(f.tolist()):
            if i in gaps:
                out[row, k] = side.lift[i]
                k += 1
        return out

    def above(part: pd.DataFrame) -> pd.DataFrame:
        a, b = int(part["a"].iloc[0]), int(part["b"].iloc[0])
        shape = (len(blocks[a][1]), len(blocks[b][1]))
        by = {fold: np.frombuffer(m, np.float64).reshape(shape) for fold, m in zip(part["fold"], part["m"])}
        everything = sum(by.values(), np.zeros(shape))
        found = []
        for label, side in sides.items():
            if side.n <= 0:
                continue
            product = lifted(a, side) @ (everything - (by.get(label, 0.0) if own_side else 0.0)) @ lifted(b, side).T
            i, j = blocks[a][0], blocks[b][0]
            cov = product / side.n - np.outer(side.mean[1 + i], side.mean[1 + j])
            with np.errstate(invalid="ignore", divide="ignore"):
                corr = np.round(cov / np.outer(side.sd[i], side.sd[j]), 12)
            hit = np.argwhere(np.isfinite(corr) & (np.abs(corr) > limit))
            first, second = i[hit[:, 0]], j[hit[:, 1]]
            keep = first < second
            found.append(pd.DataFrame({"label": label, "i": first[keep], "j": second[keep]}))
        return pd.concat(found) if found else pd.DataFrame({"label": [], "i": [], "j": []})

    def dropped(part: pd.DataFrame) -> pd.DataFrame:
        label = part["label"].iloc[0]
        out = sorted(settle_pairs(part[["i", "j"]].to_numpy(), sides[label].to_target, safe))
        return pd.DataFrame({"label": [label] * len(out), "feature": out})

    pairs = held.where("a >= 0").groupBy("a", "b").applyInPandas(above, "label string, i int, j int")
    gone: dict[str, set[int]] = {label: set() for label in lifts}
    for r in pairs.groupBy("label").applyInPandas(dropped, "label string, feature int").collect():  # one row a dropped feature
        gone[r["label"]].add(r["feature"])
    scratch.release()
    return sides, gone
