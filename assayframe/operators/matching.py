"""Joins between corpora: fidelity audits, vocabularies, backfills, alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.functions.numeric import ratio
from assayframe.operators.ranking import running_totals
from assayframe.sources.session import settle

#: Pairs of one key that a task makes, about; where that makes more than so many tasks for a partition of a shuffle, up to so many times as many.
PAIRS_A_TASK = 4_000_000
_TASKS_A_PARTITION, _LARGER = 16, 16
_HELD_ROWS = 500_000  # rows of the first side that a task holds, about


def fidelity_by_variant(a: DataFrame, b: DataFrame, variants: list[str]) -> DataFrame:
    """Overlap and offset of corpus ``a`` (key, value) against each variant of
    ``b`` (variant, key, value), over every pair of rows sharing a key.

    The statistics are those of the many-to-many join, got without making its pairs:
    counts, sums and products come from per-key totals, and the mean absolute
    difference from prefix sums along the sorted values of both sides. Both sides
    are counted per (key, value) before anything is shuffled, and a hot key is
    spread over range slices. NULL keys are dropped; NULL values make pairs that
    are counted but not averaged.
    """
    spark = a.sparkSession
    a = a.where(F.col("key").isNotNull()).groupBy("key", "value").agg(F.count(F.lit(1)).alias("na"))
    a = a.select(F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant"), "key", "value", "na", F.lit(0).cast("bigint").alias("nb"))
    b = b.where(F.col("key").isNotNull()).groupBy("variant", "key", "value").agg(F.count(F.lit(1)).alias("nb"))
    b = b.select("variant", "key", "value", F.lit(0).cast("bigint").alias("na"), "nb")
    both = a.unionByName(b).groupBy("variant", "key", "value").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    both = settle(both, "fidelity-values")

    has = F.col("value").isNotNull()
    # Values are shifted by a common constant so that sums of squares keep their digits.
    shift = both.agg(F.avg("value")).first()[0] or 0.0
    v = F.col("value") - F.lit(float(shift))
    per_key = both.groupBy("variant", "key").agg(
        F.sum("na").alias("ra"), F.sum("nb").alias("rb"),
        *[F.sum(F.when(has, F.col(n))).alias("c" + s) for n, s in (("na", "a"), ("nb", "b"))],
        *[F.sum(F.col(n) * v).alias("s" + s) for n, s in (("na", "a"), ("nb", "b"))],
        *[F.sum(F.col(n) * v * v).alias("q" + s) for n, s in (("na", "a"), ("nb", "b"))],
    )
    per_key = settle(per_key, "fidelity-keys")
    matched = (F.col("ra") > 0) & (F.col("rb") > 0)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    pair = lambda e: F.sum(F.when(matched, e))
    head = per_key.groupBy("variant").agg(
        F.sum("ra").alias("n_expt"), F.sum("rb").alias("n_other"),
        F.count_if(matched).alias("n_matched"),
        F.coalesce(pair(F.col("ra") * F.col("rb")), F.lit(0)).alias("pairs"),
        pair(z("ca") * z("cb")).alias("n"),
        pair(z("cb") * z("sa")).alias("sa"), pair(z("ca") * z("sb")).alias("sb"),
        pair(z("cb") * z("qa")).alias("qa"), pair(z("ca") * z("qb")).alias("qb"),
        pair(z("sa") * z("sb")).alias("ab"),
    )

    live = both.where(has).join(
        per_key.where(matched & (F.col("ca") > 0) & (F.col("cb") > 0)).select(
            "variant", "key", F.col("cb").alias("tot_n"), F.col("sb").alias("tot_s")
        ),
        ["variant", "key"],
    ).withColumn("v", v)
    run = running_totals(
        live, ["value"], {"run_n": F.col("nb"), "run_s": F.col("nb") * F.col("v")}, ["variant", "key"]
    )
    below = F.col("v") * F.col("run_n") - F.col("run_s")
    above = (F.col("tot_s") - F.col("run_s")) - F.col("v") * (F.col("tot_n") - F.col("run_n"))
    absdiff = run.where("na > 0").groupBy("variant").agg(F.sum(F.col("na") * (below + above)).alias("abs_sum"))

    n = F.col("n").cast("double")
    cov = F.col("ab") - ratio(F.col("sa") * F.col("sb"), n)
    va = F.col("qa") - ratio(F.col("sa") * F.col("sa"), n)
    vb = F.col("qb") - ratio(F.col("sb") * F.col("sb"), n)
    r = F.when((va > 1e-12 * F.col("qa")) & (vb > 1e-12 * F.col("qb")), ratio(cov, F.sqrt(F.abs(va)) * F.sqrt(F.abs(vb))))
    out = head.join(absdiff, "variant", "left").select(
        "variant", "n_expt", "n_other",
        F.col("n_matched").alias("n_matched_compositions"),
        F.coalesce(ratio(F.col("n_matched"), F.col("n_expt")) * 100, F.lit(0.0)).alias("pct_matched_compositions"),
        F.col("pairs").alias("n_compared_pairs"),
        ratio(F.col("sa") - F.col("sb"), n).alias("mean_signed_diff"),
        ratio(F.col("abs_sum"), n).alias("mae"),
        F.when(F.col("pairs") > 1, r).alias("pearson_r"),
    )
    order = spark.createDataFrame([(v, i) for i, v in enumerate(variants)], "variant string, position bigint")
    return order.join(out, "variant", "left")


def fidelity(a: DataFrame, b: DataFrame) -> DataFrame:
    """One audit row for corpus ``a`` against ``b`` (key, value each)."""
    return fidelity_by_variant(a, b.withColumn("variant", F.lit("raw")), ["raw"]).drop("variant", "position")


def fidelity_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """The joined pairs themselves: key, a, b, diff. The only operator whose output
    is the many-to-many join; use ``fidelity`` when only its statistics are needed.

    The pairs of a key are a rectangle, and it is cut into tiles with about as many rows of either side, as far as the key has
    them: rows of ``a`` are copied to each column of tiles and rows of ``b`` to each line of them. A tile of n pairs so takes
    about two square roots of n rows, which is what is shuffled and held; the pairs themselves are made as they are read."""
    left = a.where(F.col("key").isNotNull()).select("key", F.col("value").alias("a"), F.rand(5).alias("_at"))
    right = b.where(F.col("key").isNotNull()).select("key", F.col("value").alias("b"), F.rand(7).alias("_at"))
    n = left.groupBy("key").agg(F.count(F.lit(1)).alias("na")).join(right.groupBy("key").agg(F.count(F.lit(1)).alias("nb")), "key")
    shares = settle(n.select("key", "na", "nb", (F.col("na").cast("double") * F.col("nb")).alias("load")), "pair-shares")
    total = shares.agg(F.sum("load")).first()[0] or 0.0
    if total <= PAIRS_A_TASK:
        return left.drop("_at").join(right.drop("_at"), "key").withColumn("diff", F.col("a") - F.col("b"))
    spread = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tile = max(PAIRS_A_TASK, min(total / (_TASKS_A_PARTITION * spread), _LARGER * PAIRS_A_TASK))
    # a key with few rows on one side has longer tiles, and none has more parts than rows to divide
    wide = lambda own, other: F.greatest(F.lit(tile) / F.col(other), F.least(F.col(own).cast("double"), F.lit(tile**0.5)))
    parts = lambda own, other: F.least(F.ceil(F.col(own) / F.least(wide(own, other), F.lit(_HELD_ROWS))), F.col(own)).cast("int")
    shares = shares.select("key", "na", parts("na", "nb").alias("of_a"), parts("nb", "na").alias("of_b"))
    held = shares.agg(F.sum(F.col("na").cast("double") * F.col("of_b"))).first()[0]

    def dealt(rows: DataFrame, value: str, mine: str, others: str) -> DataFrame:
        own = F.floor(F.col("_at") * F.col(f"of_{mine}")).cast("int").alias(f"part_{mine}")
        each = F.explode(F.sequence(F.lit(0), F.col(f"of_{others}") - 1)).alias(f"part_{others}")
        return rows.join(shares.drop("na"), "key").select("key", value, own, each)

    tasks = max(spread, int(total // tile), int(held // _HELD_ROWS))
    on = ["key", "part_a", "part_b"]
    met = dealt(left, "a", "a", "b").repartition(tasks, *on).hint("shuffle_hash").join(dealt(right, "b", "b", "a").repartition(tasks, *on), on)
    return met.select("key", "a", "b", (F.col("a") - F.col("b")).alias("diff"))


def compare_vocabularies(a: DataFrame, b: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """One row comparing two element sets (column element): sizes, shared, the
    elements on one side only (ordered by ``order``: element, z; else by name), subset flags."""
    sets = a.select("element").distinct().withColumn("in_a", F.lit(True)).join(
        b.select("element").distinct().withColumn("in_b", F.lit(True)), "element", "full_outer"
    )
    if order is not None:
        sets = sets.join(order.select("element", "z"), "element", "left")
    else:
        sets = sets.withColumn("z", F.lit(0))
    in_a, in_b = F.coalesce("in_a", F.lit(False)), F.coalesce("in_b", F.lit(False))
    listed = lambda cond: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("z", "element")))), lambda s: s["element"]), ","
    )
    only_a, only_b = in_a & ~in_b, in_b & ~in_a
    return sets.agg(
        F.count_if(in_a).alias("n_elements_a"), F.count_if(in_b).alias("n_elements_b"),
        F.count_if(in_a & in_b).alias("n_shared"),
        listed(only_a).alias("only_in_a"), listed(only_b).alias("only_in_b"),
        (F.count_if(only_a) == 0).alias("a_subset_of_b"), (F.count_if(only_b) == 0).alias("b_subset_of_a"),
    )


def first_by_priority(sources: list[DataFrame], key: str) -> DataFrame:
    """One row per key from the earliest source holding it (same columns in each)."""
    tagged = [s.withColumn("_p", F.lit(i)) for i, s in enumerate(sources)]
    rest = [c for c in sources[0].columns if c != key]
    allrows = reduce(lambda x, y: x.unionByName(y), tagged)
    best = allrows.groupBy(key).agg(F.min_by(F.struct(*rest), "_p").alias("_r"))
    return best.select(key, "_r.*")


def backfill_attributes(
    ids: DataFrame, key: str, attrs: list[str], sources: list[DataFrame],
    cache: DataFrame | None = None, fetched: DataFrame | None = None, min_overlap: float = 0.1,
) -> DataFrame | None:
    """Attributes for every requested id, from the first usable source.

    A source is usable when it has the columns and a non-NULL first attribute for
    at least one requested id. Failing all, the cache is used if it holds at least
    ``min_overlap`` of the ids, topped up with ``fetched`` rows, which beat cached
    ones. Returns None when nothing is usable; ids without a match get NULLs.
    """
    ids = ids.select(key)
    for src in sources:
        if not {key, *attrs} <= set(src.columns):
            continue
        known = src.where(F.col(attrs[0]).isNotNull()).join(ids, key, "left_semi")
        if not known.isEmpty():
            return ids.join(src.select(key, *attrs), key, "left")
    if cache is None:
        return None
    held = ids.join(cache.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    seen = held.agg(F.count(F.lit(1)).alias("n"), F.count("_hit").alias("hit")).first()
    if seen["hit"] < seen["n"] * min_overlap:
        return None
    parts = [cache.select(key, *attrs)] if fetched is None else [fetched.select(key, *attrs), cache.select(key, *attrs)]
    return ids.join(first_by_priority(parts, key), key, "left")


def misaligned(artifact: DataFrame, current: DataFrame, row_id: str, key: str) -> DataFrame:
    """Artifact rows whose key differs from the caller's, or whose row is unknown."""
    cur = current.select(row_id, F.col(key).alias("_current"), F.lit(True).alias("_known"))
    out = artifact.join(cur, row_id, "left")
    return out.where(F.col("_known").isNull() | ~F.col(key).eqNullSafe(F.col("_current"))).drop("_known")


def assert_aligned(artifact: DataFrame, current: DataFrame, row_id: str, key: str) -> DataFrame:
    """Return the artifact, or raise if any of its rows no longer carries the caller's key."""
    bad = misaligned(artifact, current, row_id, key).first()
    if bad is not None:
        raise RuntimeError(f"row mismatch: the artifact and the table disagree, e.g. {bad.asDict()}")
    return artifact


def apply_subset(train: DataFrame, subsets: DataFrame, arm: str) -> DataFrame:
    """Training rows (split, fold, row_id) cut down to an arm's; a fold the arm lacks raises."""
    on = ["split", "fold"]
    chosen = subsets.where(F.col("arm") == arm)
    lacking = train.select(*on).distinct().join(chosen.select(*on).distinct(), on, "left_anti").first()
    if lacking is not None:
        raise KeyError(f"arm {arm!r} has no subset for {lacking.asDict()}")
    return train.join(chosen.select(*on, "row_id"), [*on, "row_id"], "left_semi")


def join_predictions(frames: dict[str, DataFrame], on: list[str] | None = None) -> DataFrame:
    """Predictions of several models on their shared rows: y_true and one y_pred_<model> each."""
    on = on or ["split", "fold", "seed", "row_id"]
    names = list(frames)
    out = frames[names[0]].select(*on, "y_true", F.col("y_pred").alias(f"y_pred_{names[0]}"))
    for n in names[1:]:
        out = out.join(frames[n].select(*on, F.col("y_pred").alias(f"y_pred_{n}")), on)
    return out
