"""Split constructors.

Random choices are orders by a salted hash; an exact quota is a threshold on that
order (see ``draw_cutoffs``), so assigning rows never shuffles them. Folds are
kept as test-side assignments (row_id, fold); ``expand_folds`` gives the long form
(split, fold, role, row_id) as a narrow projection when it is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.functions.draws import draw_hash
from assayframe.operators.composition import MANY, NONE
from assayframe.operators.clustering import clusters, farthest
from assayframe.operators.ranking import draw_cutoffs, global_rank, with_cut
from assayframe.sources.session import settle

FRACTIONS = (0.1, 0.25, 0.5, 1.0)
EXTRAPOLATION_THRESHOLD = 4.0


def _drawn(rows: DataFrame, seed: int, label: str | Column) -> DataFrame:
    return rows.withColumn("h", draw_hash(seed, label, "row_id"))


def ceil_share(share: float, n: int) -> int:
    """Test rows of a share: rounded up."""
    import math

    return math.ceil(share * n)


def random_parts(rows: DataFrame, seed: int = 42, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """rows plus ``part``: the test quota first, then val / (1 - test) of the rest, else train."""
    n = rows.count()
    n_test = ceil_share(test, n)
    n_val = ceil_share(val / (1 - test), n - n_test)
    drawn = _drawn(rows, seed, "parts")
    cuts = draw_cutoffs(drawn, {"test": n_test, "val": n_test + n_val})
    out = with_cut(with_cut(drawn, cuts, "test", "_t"), cuts, "val", "_v")
    part = F.when(F.col("_t"), "test").when(F.col("_v"), "val").otherwise("train")
    return out.withColumn("part", part).drop("h", "_t", "_v")


def _largest_remainder(counts: DataFrame, size: Column, count: str, whole: str, stratum: str, over: list[str], name: str) -> DataFrame:
    """Split ``size`` seats over strata in proportion to ``count`` / ``whole``:
    whole parts first, then one each by largest remainder, ties by stratum name."""
    base = F.expr(f"`{count}` * _size div `{whole}`")
    rem = F.col(count) * F.col("_size") % F.col(whole)
    t = counts.withColumn("_size", size.cast("bigint")).withColumn("_base", base).withColumn("_rem", rem)
    parts = over or [F.lit(0)]
    left = F.col("_size") - F.sum("_base").over(Window.partitionBy(*parts))
    rank = F.row_number().over(Window.partitionBy(*parts).orderBy(F.desc("_rem"), stratum))
    t = t.withColumn("_left", left).withColumn("_rank", rank)
    return t.withColumn(name, (F.col("_base") + (F.col("_rank") <= F.col("_left")).cast("bigint"))).drop(
        "_size", "_base", "_rem", "_left", "_rank"
    )


def stratum_of(category: Column) -> Column:
    """The two catch-all categories form one stratum."""
    return F.when(category.isin(MANY, NONE), NONE).otherwise(category)


def _strata(rows: DataFrame, test_size: float) -> DataFrame:
    """(stratum, c, n, n_train, q_train, q_test): test and train quotas of each stratum."""
    counts = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("n", F.sum("c").over(Window.partitionBy(F.lit(0))))
    counts = counts.withColumn("n_train", F.col("n") - F.ceil(F.lit(test_size) * F.col("n")))
    out = _largest_remainder(counts, F.col("n_train"), "c", "n", "stratum", [], "q_train")
    return settle(out.withColumn("q_test", F.col("c") - F.col("q_train")), "strata")


def stratified_holdout(rows: DataFrame, seed: int = 42, test_size: float = 0.1) -> DataFrame:
    """rows (row_id, stratum, ...) plus ``is_test``, in proportion within every stratum."""
    quotas = _strata(rows, test_size).select("stratum", F.lit("test").alias("tag"), F.col("q_test").alias("take"))
    drawn = _drawn(rows, seed, "stratified")
    cuts = draw_cutoffs(drawn, quotas, ["stratum"])
    return with_cut(drawn, cuts, "test", "is_test", ["stratum"]).drop("h")


def fraction_label(f: float) -> str:
    return f"{int(round(f * 100))}pct"


def data_efficiency(rows: DataFrame, fractions: tuple[float, ...] = FRACTIONS, seed: int = 42, test_size: float = 0.1) -> DataFrame:
    """Long folds "10pct", "25pct", ...: one fixed stratified test set, and training
    subsets stratified and nested within one another."""
    strata = _strata(rows, test_size)
    subs = strata.select(
        "stratum", "q_train", "q_test", "n_train",
        F.inline(F.array(*[F.struct(F.lit(fraction_label(f)).alias("tag"), F.lit(f).alias("f")) for f in fractions if f < 1.0])),
    )
    subs = _largest_remainder(subs, F.floor(F.col("f") * F.col("n_train")), "q_train", "n_train", "stratum", ["tag"], "q")
    quotas = subs.select("stratum", "tag", (F.col("q_test") + F.col("q")).alias("take")).unionByName(
        strata.select("stratum", F.lit("test").alias("tag"), F.col("q_test").alias("take"))
    )
    drawn = _drawn(rows, seed, "stratified")
    cuts = draw_cutoffs(drawn, quotas, ["stratum"])
    out = with_cut(drawn, cuts, "test", "_test", ["stratum"])
    members = []
    for f in fractions:
        label = fraction_label(f)
        if f < 1.0:
            out = with_cut(out, cuts, label, f"_in_{label}", ["stratum"])
            inside = F.col("_test") | F.col(f"_in_{label}")
        else:
            inside = F.lit(True)
        members.append(F.when(inside, F.lit(label)))
    role = F.when(F.col("_test"), "test").otherwise("train")
    return out.select(
        F.lit("data_efficiency").alias("split"), F.explode(F.array_compact(F.array(*members))).alias("fold"),
        role.alias("role"), "row_id",
    )


def labels_of(assigned: DataFrame) -> list[str]:
    """Sorted fold labels: every row of the long form is written once for each."""
    return sorted(r[0] for r in assigned.where(F.col("fold").isNotNull()).select("fold").distinct().collect())


def fold_counts(assigned: DataFrame, split: str) -> DataFrame:
    """(split, fold, n_train, n_test) of test-side assignments (row_id, fold), without their long form:
    a fold trains on all rows but its own."""
    own = assigned.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"))
    total = F.sum("n_test").over(Window.partitionBy(F.lit(0)))
    counts = own.withColumn("n_train", total - F.col("n_test")).where(F.col("fold").isNotNull())
    return counts.select(F.lit(split).alias("split"), "fold", "n_train", "n_test")


def listed(counts: DataFrame, splits: list[str]) -> DataFrame:
    """The counts of the splits listed; one without folds keeps a row with NULL fold."""
    wanted = counts.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    return wanted.join(counts, "split", "left").na.fill(0, ["n_train", "n_test"])


def expand_folds(assigned: DataFrame, split: str, labels: list[str] | None = None) -> DataFrame:
    """(row_id, fold) to the long form: every row is test in its own fold and train in
    the others. A row with a NULL fold is train everywhere."""
    labels = labels_of(assigned) if labels is None else labels
    long = assigned.select("row_id", F.col("fold").alias("_own"), F.explode(F.array(*[F.lit(x) for x in labels]).cast("array<string>")).alias("fold"))
    role = F.when(F.col("_own").eqNullSafe(F.col("fold")), "test").otherwise("train")
    return long.select(F.lit(split).alias("split"), "fold", role.alias("role"), "row_id")


def single_fold(rows: DataFrame, split: str, fold: str = "0", flag: str = "is_test") -> DataFrame:
    role = F.when(F.col(flag), "test").otherwise("train")
    return rows.select(F.lit(split).alias("split"), F.lit(fold).alias("fold"), role.alias("role"), "row_id")


def leave_one_category_out(rows: DataFrame, category: str = "category") -> DataFrame:
    """(row_id, fold): each category is a fold; the catch-all ones are never tested."""
    c = F.col(category)
    return rows.select("row_id", F.when(~c.isin(MANY, NONE), c).alias("fold"))


def _dealt(groups: DataFrame, k: int) -> DataFrame:
    """Groups dealt to folds back and forth in order of falling size. Needs no more
    than the rank of each group, so it serves any number of groups."""
    keyed = groups.select("grp", (-F.col("size")).alias("_neg"), F.md5("grp").alias("_h"))
    ranked = global_rank(keyed, ["_neg", "_h", "grp"])
    lap, spot = F.expr(f"rank div {k}"), F.col("rank") % k
    fold = F.when(lap % 2 == 0, spot).otherwise(k - 1 - spot)
    return ranked.select("grp", fold.cast("int").cast("string").alias("fold"))


def _balanced(groups: DataFrame, k: int) -> DataFrame:
    """Groups by falling size (ties by name), each to the fold with the fewest rows so far (ties: the
    lower fold).

    Groups of one size take the folds in the order of (load + t * size, fold), t = 0, 1, ...: the
    rows of numbers of all folds, merged. The loads tell how many each fold takes, so the driver walks the
    distinct sizes (fewer than the root of twice the rows); groups and places meet by rank.
    """
    sizes = groups.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect()
    loads, takes = [0] * k, []
    for size, n in sizes:
        taken = _turns(loads, size, n)
        takes += [(size, fold, load, t) for fold, (load, t) in enumerate(zip(loads, taken)) if t]
        loads = [load + size * t for load, t in zip(loads, taken)]
    places = groups.sparkSession.createDataFrame(takes, "size bigint, fold int, load bigint, n bigint")
    turn = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))
    places = places.select((-F.col("size")).alias("_neg"), "fold", "load", turn.alias("t"))
    places = places.select("_neg", (F.col("load") - F.col("t") * F.col("_neg")).alias("value"), "fold")
    places = global_rank(places, ["_neg", "value", "fold"]).select("rank", F.col("fold").cast("string").alias("fold"))
    keyed = global_rank(groups.select("grp", (-F.col("size")).alias("_neg")), ["_neg", "grp"])
    return keyed.join(places, "rank").select("grp", "fold")


def _turns(loads: list[int], size: int, n: int) -> list[int]:
    """How many of n groups of one size each fold takes."""

    def below(value: int) -> list[int]:
        return [max(0, -((load - value) // size)) for load in loads]

    low, high = min(loads), max(loads) + size * n
    while low < high:  # the largest value with no more than n places below it
        middle = (low + high + 1) // 2
        low, high = (middle, high) if sum(below(middle)) <= n else (low, middle - 1)
    taken = below(low)
    for fold, load in enumerate(loads):
        if sum(taken) < n and load + size * taken[fold] == low:
            taken[fold] += 1
    return taken


def group_kfold(rows: DataFrame, group: str, n_splits: int, deal: bool = False) -> tuple[DataFrame | None, int]:
    """((row_id, fold), k): no group on two sides. NULL groups are left out of both;
    k = min(n_splits, groups), and fewer than two groups give (None, 0)."""
    valid = rows.where(F.col(group).isNotNull()).select("row_id", F.col(group).cast("string").alias("grp"))
    groups = settle(valid.groupBy("grp").agg(F.count(F.lit(1)).alias("size")), "groups")
    k = min(n_splits, groups.count())
    if k < 2:
        return None, 0
    folds = settle(_dealt(groups, k) if deal else _balanced(groups, k), "group-folds")
    return valid.join(folds, "grp").select("row_id", "fold"), k


def chemical_system_folds(rows: DataFrame, system: str = "system", n_splits: int = 10) -> tuple[DataFrame | None, int]:
    """Group k-fold by element set. Many systems are expected, so groups are dealt by size."""
    return group_kfold(rows, system, n_splits, deal=True)


def crystal_system_folds(rows: DataFrame, attribute: str, n_splits: int = 7) -> tuple[DataFrame | None, int]:
    """Group k-fold by an attribute, largest groups first to the lightest fold."""
    return group_kfold(rows, attribute, n_splits)


def member_holdout(member_groups: DataFrame, split: str = "periodic_group") -> DataFrame:
    """One fold per group of constituents: test = rows with any member of the group,
    train = the others. ``member_groups`` has row_id, grp (one row per membership)."""
    labels = labels_of(member_groups.select(F.col("grp").alias("fold")))
    sets = member_groups.groupBy("row_id").agg(F.collect_set("grp").alias("_own"))
    long = sets.select("row_id", "_own", F.explode(F.array(*[F.lit(x) for x in labels])).alias("fold"))
    role = F.when(F.array_contains("_own", F.col("fold")), "test").otherwise("train")
    return long.select(F.lit(split).alias("split"), "fold", role.alias("role"), "row_id")


def range_extrapolation(
    rows: DataFrame, target: str, threshold: float = EXTRAPOLATION_THRESHOLD, seed: int = 42, min_test: int = 10
) -> DataFrame:
    """Long folds of the range test: ``extrapolation`` (train below the threshold, test
    at or above it), ``random_control`` (same sizes, random rows) and ``inrange_control``
    (a random half of the wide rows joins the training side). The target is compared
    in single precision."""
    wide = F.col(target).cast("float") >= F.lit(threshold).cast("float")
    flagged = rows.where(F.col(target).isNotNull()).select("row_id", wide.alias("_wide"))
    n_wide = flagged.where("_wide").count()
    if n_wide < min_test:
        raise ValueError(f"only {n_wide} rows reach {threshold}; need {min_test}")
    drawn = _drawn(flagged, seed, "random_control")
    cuts = draw_cutoffs(drawn, {"test": n_wide})
    out = with_cut(drawn, cuts, "test", "_control")
    out = out.withColumn("h", draw_hash(seed, "inrange_control", "row_id"))
    half = draw_cutoffs(out.where("_wide"), {"train": n_wide // 2})
    out = with_cut(out, half, "train", "_half")
    tests = {
        "extrapolation": F.col("_wide"),
        "random_control": F.col("_control"),
        "inrange_control": F.col("_wide") & ~F.col("_half"),
    }
    sides = [
        F.struct(F.lit(n).alias("fold"), F.when(t, "test").otherwise("train").alias("role")) for n, t in tests.items()
    ]
    return out.select(F.lit("extrapolation").alias("split"), F.inline(F.array(*sides)), "row_id")


def feature_holdout(rows: DataFrame, vector: str, k: int = 8, seed: int = 42, min_test: int = 30, steps: int = 10) -> DataFrame | None:
    """(row_id, is_test): the cluster of the standardised array column ``vector`` whose centre is farthest from the mean;
    None when it holds fewer than ``min_test`` rows. Not part of the suite."""
    labelled, centres = clusters(rows, vector, k, seed, steps)
    if not centres:
        return None
    out = settle(labelled.select("row_id", (F.col("cluster") == farthest(centres)).alias("is_test")), "far-cluster")
    return None if out.where("is_test").count() < min_test else out


# How many validation rows a training side of n gives up; 0 means none.
VALIDATION_RULES = {
    # a tenth, unless either side would have fewer than two rows
    "checkpoint": lambda n: F.when(
        (F.bround(n * 0.1, 0) >= 2) & (n - F.bround(n * 0.1, 0) >= 2), F.bround(n * 0.1, 0)
    ).otherwise(0.0),
    # a tenth, at least one
    "arm": lambda n: F.greatest(F.bround(n * 0.1, 0), F.lit(1.0)),
    # a tenth, at most 2000, at least 32
    "bounded": lambda n: F.greatest(F.least(F.floor(n / 10), F.lit(2000)), F.lit(32)),
    # a tenth rounded down, at least one
    "tree": lambda n: F.greatest(F.floor(n / 10), F.lit(1)),
}


def carve_validations(train: DataFrame, rules: list[str], seed: int = 42) -> DataFrame:
    """(rule, fold, row_id, is_val) of train (fold, row_id): each rule's share drawn inside each fold. All rules
    cut the same draw, so the rows are counted and read once for all of them."""
    n = F.col("n")
    takes = [F.struct(F.lit(r).alias("tag"), F.least(VALIDATION_RULES[r](n).cast("bigint"), n).alias("take")) for r in rules]
    quotas = settle(train.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).select("fold", F.inline(F.array(*takes))), "carve")
    out = _drawn(train, seed, F.concat(F.lit("val/"), F.col("fold")))
    cuts = draw_cutoffs(out, quotas, ["fold"])
    for i, rule in enumerate(rules):
        out = with_cut(out, cuts, rule, f"_val{i}", ["fold"])
    flags = [F.struct(F.lit(r).alias("rule"), F.col(f"_val{i}").alias("is_val")) for i, r in enumerate(rules)]
    return out.select("fold", "row_id", F.inline(F.array(*flags))).select("rule", "fold", "row_id", "is_val")


def carve_validation(train: DataFrame, rule: str, seed: int = 42) -> DataFrame:
    """train (fold, row_id) plus ``is_val``, drawn inside each fold under the named rule."""
    return carve_validations(train, [rule], seed).drop("rule")


def named_folds(folds: DataFrame, label: str, position: str) -> DataFrame:
    """Fold name: the label, or the position of an unlabelled fold."""
    return folds.withColumn("fold", F.coalesce(F.col(label).cast("string"), F.col(position).cast("string")))


def manifest(long_folds: DataFrame, splits: list[str] | None = None) -> DataFrame:
    """(split, fold, n_train, n_test); a listed split without folds keeps a row with NULL fold."""
    out = long_folds.groupBy("split", "fold").agg(
        F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test")
    )
    return out if splits is None else listed(out, splits)
