"""The frozen suite of seven splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.operators import splits as S

# The splits of the suite, in reading order.
SPLIT_ORDER = (
    "random", "lomo", "chemical_system", "periodic_group", "crystal_system", "data_efficiency", "extrapolation",
)
EXCLUDED = {"feature_ood": "its folds move with the descriptors chosen, so they pin down no property of a row"}


def _splits(rows: DataFrame, threshold: float, seed: int, n_splits: int) -> tuple[list[tuple], list[DataFrame], dict[str, str]]:
    """Splits with a test side a row (name, assignments, labels or None), the others in long form, and the reasons for those left out."""
    skipped: dict[str, str] = {}
    strata = rows.select("row_id", S.stratum_of(F.col("category")).alias("stratum"))
    long = [S.single_fold(S.stratified_holdout(strata, seed), "random"), S.data_efficiency(strata, seed=seed)]
    assigned = [("lomo", S.leave_one_category_out(rows), None)]
    grouped = [
        ("chemical_system", "system", lambda: S.chemical_system_folds(rows, "system", n_splits)),
        ("periodic_group", "groups", lambda: S.group_kfold(rows, "groups", n_splits, deal=True)),
        ("crystal_system", "attribute", lambda: S.crystal_system_folds(rows, "attribute")),
    ]
    for split, column, make in grouped:
        if column not in rows.columns:
            skipped[split] = f"no column {column}"
            continue
        folds, k = make()
        if folds is None:
            skipped[split] = "fewer than two groups"
        else:
            assigned.append((split, folds, [str(i) for i in range(k)]))
    try:
        long.append(S.range_extrapolation(rows, "target", threshold, seed))
    except ValueError as few:
        skipped["extrapolation"] = str(few)
    return assigned, long, skipped


def build_suite(
    rows: DataFrame, threshold: float = S.EXTRAPOLATION_THRESHOLD, seed: int = 42, n_splits: int = 10
) -> tuple[DataFrame, dict[str, str]]:
    """Long folds of every split, and the reason for each split that has none.

    ``rows`` has row_id, category, system, groups, target and, when known, attribute.
    """
    assigned, long, skipped = _splits(rows, threshold, seed, n_splits)
    return reduce(lambda a, b: a.unionByName(b), [*long, *(S.expand_folds(df, name, labels) for name, df, labels in assigned)]), skipped


def suite_manifest(
    rows: DataFrame, threshold: float = S.EXTRAPOLATION_THRESHOLD, seed: int = 42, n_splits: int = 10
) -> DataFrame:
    """(split, fold, n_train, n_test, note) for every split of the suite and the excluded ones. Folds with
    one test side a row are counted from it; only the few others are written out to be counted."""
    assigned, long, skipped = _splits(rows, threshold, seed, n_splits)
    counts = S.manifest(reduce(lambda a, b: a.unionByName(b), long))
    for name, df, _ in assigned:
        counts = counts.unionByName(S.fold_counts(df, name))
    notes = {**skipped, **EXCLUDED}
    pairs = [x for k, v in notes.items() for x in (F.lit(k), F.lit(v))]
    m = S.listed(counts, list(SPLIT_ORDER) + list(EXCLUDED))
    return m.withColumn("note", F.try_element_at(F.create_map(*pairs), F.col("split")))
