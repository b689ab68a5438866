"""Training arms: de-duplicated subsets, their size-matched controls, locked tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.functions.draws import draw_hash
from assayframe.operators.dedup import ARM_THRESHOLD, Scale
from assayframe.operators.neighbours import greedy_cases
from assayframe.operators.ranking import draw_cutoffs, with_cut
from assayframe.operators.splits import ceil_share
from assayframe.sources.artifacts import Ledger
from assayframe.sources.session import settle


def survivors(rows: DataFrame, comp: DataFrame, scale: Scale, threshold: float, by: list[str] | None = None, **kw) -> DataFrame:
    """Rows (``by`` columns, row_id, item) whose item survives the greedy rule run on the
    items of their group. The decision is per item, so every row of a kept item stays. All
    groups are resolved from one table of near pairs."""
    by = list(by or [])
    name = F.concat_ws("/", *by) if by else F.lit("all")
    tagged = rows.withColumn("grp", name)
    members = tagged.select("grp", F.col("item").alias("row_id")).distinct()
    kept = greedy_cases(comp, scale, [threshold], members, **kw).select("grp", F.col("row_id").alias("item"))
    return tagged.join(kept, ["grp", "item"], "left_semi").select(*rows.columns)


def size_matched(rows: DataFrame, sizes: DataFrame, seed: int) -> DataFrame:
    """A random subset of each (split, fold) of the given size (split, fold, take), drawn
    under seed and "split/fold", so one fold's draw never depends on another's."""
    on = ["split", "fold"]
    drawn = rows.withColumn("h", draw_hash(seed, F.concat_ws("/", *on), "row_id"))
    cuts = draw_cutoffs(drawn, sizes.withColumn("tag", F.lit("take")), on)
    return with_cut(drawn, cuts, "take", "_in", on).where("_in").drop("h", "_in")


def train_subsets(
    train: DataFrame, comp: DataFrame, scale: Scale, threshold: float = ARM_THRESHOLD, seed: int = 42
) -> DataFrame:
    """(split, fold, arm, row_id, item) for the arms ``dedup`` and ``sizematched`` of every
    fold's training side (split, fold, row_id, item); all folds run in the same jobs."""
    on = ["split", "fold"]
    dedup = settle(survivors(train, comp, scale, threshold, on), "dedup-arm")
    sizes = settle(dedup.groupBy(*on).agg(F.count(F.lit(1)).alias("take")), "arm-sizes")
    control = size_matched(train, sizes, seed)
    cols = [*on, "arm", "row_id", "item"]
    return dedup.withColumn("arm", F.lit("dedup")).select(cols).unionByName(
        control.withColumn("arm", F.lit("sizematched")).select(cols)
    )


def resumed_subsets(
    ledger: Ledger, train: DataFrame, comp: DataFrame, scale: Scale, threshold: float = ARM_THRESHOLD, seed: int = 42, by: tuple[str, ...] = ("split", "fold")
) -> DataFrame:
    """``train_subsets`` with a unit of work for each (split, fold), or for each split with ``by`` = ("split",): what a stopped run has finished
    is not done again, and nothing is published before all units are done."""
    name = F.concat_ws("/", *by)
    units = sorted(r[0] for r in train.select(name).distinct().collect())  # one row a unit
    ledger.run(units, lambda unit: train_subsets(train.where(name == unit), comp, scale, threshold, seed))
    ledger.publish(units)
    return ledger.published().drop("unit")


def arm_sizes(train: DataFrame, subsets: DataFrame) -> DataFrame:
    """(split, fold, n_train, n_dedup)."""
    on = ["split", "fold"]
    n = train.groupBy(*on).agg(F.count(F.lit(1)).alias("n_train"))
    d = subsets.where(F.col("arm") == "dedup").groupBy(*on).agg(F.count(F.lit(1)).alias("n_dedup"))
    return n.join(d, on, "left").na.fill(0, ["n_dedup"])


def locked_test_arms(
    rows: DataFrame, comp: DataFrame, scale: Scale, threshold: float = ARM_THRESHOLD,
    test_size: float = 0.15, seed: int = 42,
) -> DataFrame:
    """Membership (role, row_id, item, test_dedup_survivor) of three arms against one test set.

    The test set is carved first; the arms are the whole pool, its de-duplication and a
    random pool subset of the same size. Test rows that would survive de-duplication
    among themselves are flagged, which changes no arm.
    """
    n = rows.count()
    drawn = rows.withColumn("h", draw_hash(seed, "parts", "row_id"))
    cuts = draw_cutoffs(drawn, {"test": ceil_share(test_size, n)})
    sided = with_cut(drawn, cuts, "test", "_test").select(
        "row_id", "item", F.when(F.col("_test"), "test").otherwise("pool").alias("side")
    )
    sided = settle(sided, "sides")
    kept = settle(survivors(sided, comp, scale, threshold, ["side"]), "survivors")
    pool, test = sided.where("side = 'pool'"), sided.where("side = 'test'")
    dedup = kept.where("side = 'pool'")
    control = pool.withColumn("h", draw_hash(seed, "arms/sizematched", "row_id"))
    cut = draw_cutoffs(control, {"take": dedup.count()})
    control = with_cut(control, cut, "take", "_in").where("_in")
    flag = kept.where("side = 'test'").select("row_id", F.lit(True).alias("_s"))
    out = test.join(flag, "row_id", "left").select(
        F.lit("test").alias("role"), "row_id", "item", F.coalesce("_s", F.lit(False)).alias("test_dedup_survivor")
    )
    for role, df in (("train_full", pool), ("train_dedup", dedup), ("train_sizematched", control)):
        out = out.unionByName(df.select(F.lit(role).alias("role"), "row_id", "item", F.lit(False).alias("test_dedup_survivor")))
    return out
