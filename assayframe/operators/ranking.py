"""Exact global order statistics without a single-partition window.

``running_totals``  prefix sums along a global order (ranks, weighted positions)
``exact_quantiles`` interpolated quantiles from value counts
``draw_cutoffs``    the k-th smallest draw of every stratum, so that taking an
                    exact quota is a narrow comparison on each row
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.sources.session import settle

_SLICE = "_slice"

#: Rows that one task orders, where their number is known.
SLICE_ROWS = 1_000_000


def running_totals(
    df: DataFrame,
    order: list[str],
    measures: dict[str, Column],
    group: list[str] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add one inclusive running sum per measure, per group, along ``order``.

    Rows are range-partitioned on (group, order) and the slice number is frozen by
    writing the table, so one hot group spreads over many slices. Each slice is
    summed locally; the sums of the slices before it are added as an offset.
    ``order`` must identify a row within its group. With ``rows``, the number of rows
    where the caller knows it, a slice holds about ``SLICE_ROWS`` of them at most.
    """
    group = list(group or [])
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // SLICE_ROWS))
    tmp = {name: f"_m{i}" for i, name in enumerate(measures)}
    ranged = df.select("*", *[measures[k].alias(tmp[k]) for k in measures])
    ranged = ranged.repartitionByRange(n, *group, *order).withColumn(_SLICE, F.spark_partition_id())
    held = settle(ranged, "slices")

    keys = [*group, _SLICE]
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        held.groupBy(*keys)
        .agg(*[F.sum(t).alias(t) for t in tmp.values()])
        .select(*keys, *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(t + "_o") for t in tmp.values()])
    )
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cond = reduce(lambda a, b: a & b, [F.col(f"h.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys])
    joined = held.alias("h").join(offsets.alias("o"), cond)
    cols = [F.col(f"h.{c}") for c in held.columns] + [F.col(f"o.{t}_o") for t in tmp.values()]
    out = joined.select(*cols)
    for name, t in tmp.items():
        out = out.withColumn(name, F.col(t + "_o") + F.sum(t).over(within))
    return out.drop(_SLICE, *tmp.values(), *[t + "_o" for t in tmp.values()])


def global_rank(df: DataFrame, order: list[str], name: str = "rank", group: list[str] | None = None) -> DataFrame:
    """0-based exact rank along ``order`` (which must be unique within the group)."""
    out = running_totals(df, order, {name: F.lit(1).cast("bigint")}, group)
    return out.withColumn(name, F.col(name) - 1)


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], weight: str | None = None
) -> DataFrame:
    """Linear-interpolation quantiles per key (at least one key column):
    columns keys, ``prob``, ``quantile``.

    Equal values are counted first, so a value held by a third of the rows is one
    weighted row, and the prefix counts are spread over range slices.
    """
    w = F.col(weight) if weight else F.lit(1)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.sum(w).cast("bigint").alias("_n"))
        .where("_n > 0")
    )
    run = running_totals(counts, [value], {"_upto": F.col("_n")}, keys)
    run = settle(run, "quantiles")
    totals = run.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    targets = totals.select(
        *keys, F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"), "_total"
    ).select(
        *keys,
        "prob",
        F.floor(F.col("prob") * (F.col("_total") - 1)).alias("_lo"),
        F.ceil(F.col("prob") * (F.col("_total") - 1)).alias("_hi"),
        (F.col("prob") * (F.col("_total") - 1)).alias("_at"),
    )
    targets = settle(targets, "targets")
    covers = lambda r: (F.col(r) < F.col("_upto")) & (F.col(r) >= F.col("_upto") - F.col("_n"))
    hit = run.join(targets, keys).where(covers("_lo") | covers("_hi"))
    picked = hit.groupBy(*keys, "prob").agg(
        F.max(F.when(covers("_lo"), F.col(value))).alias("_a"),
        F.max(F.when(covers("_hi"), F.col(value))).alias("_b"),
        F.max(F.col("_at") - F.col("_lo")).alias("_f"),
    )
    return picked.select(
        *keys, "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("quantile")
    )


def draw_cutoffs(
    rows: DataFrame, quotas: DataFrame | dict[str, int], strata: list[str] | None = None, digits: int = 4
) -> DataFrame:
    """Turn quotas into thresholds on the draw order.

    ``rows``   strata columns, ``h`` (draw hash) and ``row_id``
    ``quotas`` strata columns, ``tag`` and ``take``; without strata a dict tag -> take
    Returns strata, ``tag``, ``cut_h``, ``cut_id``: a row is among the first ``take``
    of its stratum exactly when (h, row_id) <= (cut_h, cut_id). A zero quota has no row.

    The rows are counted per hash prefix, which finds the one prefix holding the
    cut; only the rows of that prefix (one in 16**digits) are then ordered.
    """
    strata = list(strata or [])
    rows = rows.select(*strata, "h", "row_id").withColumn("_b", F.substring("h", 1, digits))
    counts = rows.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    part = [F.col(s) for s in strata] or [F.lit(0)]
    upto = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_upto", F.sum("_n").over(upto))
    if isinstance(quotas, dict):
        wanted = [F.struct(F.lit(t).alias("tag"), F.lit(int(k)).cast("bigint").alias("take")) for t, k in quotas.items()]
        counts = counts.select("*", F.inline(F.array(*wanted)))
    else:
        counts = counts.join(quotas, strata)
    edges = counts.where(
        (F.col("take") > F.col("_upto") - F.col("_n")) & (F.col("take") <= F.col("_upto"))
    ).select(*strata, "_b", "tag", (F.col("take") - F.col("_upto") + F.col("_n")).alias("_left"))
    edges = settle(edges, "cut-prefixes")
    order = Window.partitionBy(*strata, "tag").orderBy("h", "row_id")
    cuts = (
        rows.join(edges, [*strata, "_b"])
        .withColumn("_r", F.row_number().over(order))
        .where("_r = _left")
        .select(*strata, "tag", F.col("h").alias("cut_h"), F.col("row_id").alias("cut_id"))
    )
    return settle(cuts, "cuts")


def with_cut(df: DataFrame, cuts: DataFrame, tag: str, name: str, strata: list[str] | None = None) -> DataFrame:
    """Add boolean ``name``: is the row within the quota ``tag`` of its stratum?

    Without strata the threshold is a single row and becomes a literal; with strata
    the thresholds are one row per stratum in a table whose size the planner knows.
    """
    key = F.struct("h", "row_id")
    one = cuts.where(F.col("tag") == tag)
    if not strata:
        cut = one.first()
        if cut is None:
            return df.withColumn(name, F.lit(False))
        bound = F.struct(F.lit(cut["cut_h"]).alias("h"), F.lit(cut["cut_id"]).alias("row_id"))
        return df.withColumn(name, key <= bound)
    one = one.select(*strata, F.struct(F.col("cut_h").alias("h"), F.col("cut_id").alias("row_id")).alias("_cut"))
    joined = df.join(one, strata, "left")
    return joined.withColumn(name, F.coalesce(key <= F.col("_cut"), F.lit(False))).drop("_cut")
