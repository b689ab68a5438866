"""Curation plans: several operators in the order a corpus goes through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.operators.composition import reduced_key, to_composition
from assayframe.operators.dedup import DEFAULT_THRESHOLD, Scale, greedy_keep, one_per_key
from assayframe.operators.filters import MAX_HULL, complete_rows, in_kept_set, with_backfill, within_hull
from assayframe.sources.session import settle


def keyed(df: DataFrame, row_id: str, formula: str) -> DataFrame:
    """Add ``_key``, the reduced composition; rows whose formula does not parse are dropped.
    Keys are made once per distinct formula."""
    distinct = df.select(F.col(formula).alias("f")).where(F.col("f").isNotNull()).distinct()
    keys = reduced_key(to_composition(distinct, "f", "f"))
    return df.join(keys.select(F.col("row_id").alias(formula), F.col("key").alias("_key")), formula)


def one_per_composition(df: DataFrame, row_id: str, formula: str, prefer_min: str | None) -> DataFrame:
    return one_per_key(keyed(df, row_id, formula), "_key", prefer_min, row_id).select(*df.columns)


def stable_corpus(
    df: DataFrame, row_id: str, formula: str, hull: str, required: list[str], limit: float = MAX_HULL, hull_source: DataFrame | None = None
) -> DataFrame:
    """Rows within the hull limit (backfilled when the column is absent), one per composition,
    the lowest hull first."""
    if hull_source is not None:
        df = with_backfill(df, hull, hull_source, row_id)
    return one_per_composition(within_hull(df, hull, required, limit), row_id, formula, hull)


def curate(
    df: DataFrame, row_id: str, formula: str, hull: str, required: list[str], scale: Scale,
    threshold: float = DEFAULT_THRESHOLD, **greedy,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Complete rows -> greedy removal over distinct formulas -> rows of kept formulas ->
    one row per composition. Returns the corpus and the table after each stage."""
    complete = complete_rows(df, required)
    distinct = complete.select(F.col(formula).alias("f")).distinct()
    comp = settle(to_composition(distinct, "f", "f"), "curation-compositions")
    kept = settle(greedy_keep(comp, scale, threshold, **greedy).withColumnRenamed("row_id", formula), "kept-formulas")
    filtered = in_kept_set(complete, kept, formula)
    final = one_per_composition(filtered, row_id, formula, hull)
    return final, {"complete": complete, "kept_formulas": kept, "filtered": filtered, "final": final}


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, n_rows): one aggregate per stage, unioned."""
    out = None
    for name, df in stages.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out
