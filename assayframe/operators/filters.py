"""Row filters of the curation steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RARE_ELEMENT_MIN = 6
MAX_HULL = 0.15
MIN_TEST, MIN_TRAIN = 20, 200


def complete_rows(df: DataFrame, required: list[str]) -> DataFrame:
    """Drop rows missing any required column."""
    return df.dropna(subset=required)


def nonzero_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target) > 0)


def with_backfill(df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    """Give ``df`` the column from ``other`` (one row per key) when it lacks it.

    Decided from the schemas; raises when neither side has the column.
    """
    if column in df.columns:
        return df
    if column not in other.columns:
        raise ValueError(f"no column {column!r} on either side")
    return df.join(other.select(key, column), key, "left")


def within_hull(df: DataFrame, hull: str, required: list[str], limit: float = MAX_HULL) -> DataFrame:
    """Complete rows with hull <= limit."""
    return complete_rows(df, [*required, hull]).where(F.col(hull) <= F.lit(limit))


def element_counts(comp: DataFrame) -> DataFrame:
    """(element, n_rows): materials per element. The long table holds an element
    once per row, so a plain count (combined map-side) is a distinct count."""
    return comp.groupBy("element").agg(F.count(F.lit(1)).alias("n_rows"))


def rows_without_rare(comp: DataFrame, rows: DataFrame, minimum: int = RARE_ELEMENT_MIN) -> DataFrame:
    """Drop the rows holding an element seen in fewer than ``minimum`` rows.

    One pass over the counts of the input, not repeated to a fixed point. ``rows``
    (row_id, ...) is what to filter; a row without elements stays out as its formula is NULL.
    """
    rare = element_counts(comp).where(F.col("n_rows") < minimum).select("element")
    hit = comp.join(rare, "element", "left_semi").select("row_id").distinct()
    return rows.join(comp.select("row_id").distinct(), "row_id", "left_semi").join(hit, "row_id", "left_anti")


def in_kept_set(df: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Keep every row whose key string was kept."""
    return df.join(kept.select(key).distinct(), key, "left_semi")


def fold_eligibility(manifest: DataFrame, min_test: int = MIN_TEST, min_train: int = MIN_TRAIN) -> DataFrame:
    """Mark folds large enough to score; the rest keep their reason."""
    small_test, small_train = F.col("n_test") < min_test, F.col("n_train") < min_train
    reason = F.concat_ws(
        ",", F.when(small_test, F.lit("test too small")), F.when(small_train, F.lit("train too small"))
    )
    return manifest.select("*", (~(small_test | small_train)).alias("eligible"), reason.alias("reason"))


def select_folds(
    manifest: DataFrame, labels: list[str] | None = None, index: int | None = None, order: list[str] | None = None
) -> DataFrame:
    """Folds by label or by position; an unknown label raises, a position past the end selects nothing."""
    if index is not None:
        ranked = manifest.orderBy(*(order or ["split", "fold"])).offset(index).limit(1)
        return ranked
    if labels is None:
        return manifest
    name = F.concat_ws("_", "split", "fold")
    chosen = manifest.where(name.isin(*labels))
    found = {r[0] for r in chosen.select(name).distinct().limit(len(labels) + 1).collect()}
    missing = sorted(set(labels) - found)
    if missing:
        raise KeyError(f"unknown or ineligible fold label(s): {missing}")
    return chosen
