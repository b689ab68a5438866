"""Weighted element-property features.

A *block* is a set of aggregates over the rows of one material plus the columns
made from them. ``build_blocks`` evaluates any number of blocks in one grouping:
the property table is joined on the element (it is vocabulary-sized) and the long
table is shuffled once, on row_id. Missing-value rules differ per column by design.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions.numeric import ratio


class Block(NamedTuple):
    aggs: list[Column]
    finals: list[Column]



def _w() -> Column:
    return F.col("amount")


def build_blocks(comp: DataFrame, props: DataFrame | None, blocks: list[Block]) -> DataFrame:
    """(row_id, feature columns of every block)."""
    joined = comp if props is None else comp.join(props, "element", "left")
    aggs = [a for b in blocks for a in b.aggs]
    return joined.groupBy("row_id").agg(*aggs).select("row_id", *[c for b in blocks for c in b.finals])


def fraction_block(vocab: list[str]) -> Block:
    """One share per vocabulary entry, 0.0 where absent."""
    aggs = [F.sum(_w()).alias("_fr_total")]
    aggs += [F.sum(F.when(F.col("element") == v, _w()).otherwise(0.0)).alias(f"_fr_{i}") for i, v in enumerate(vocab)]
    return Block(aggs, [ratio(F.col(f"_fr_{i}"), F.col("_fr_total")).alias(v) for i, v in enumerate(vocab)])


def mean_block(props: list[str], prefix: str = "", suffix: str = "_mean") -> Block:
    """Weighted mean over the elements that have the property, weights renormalised;
    NULL when none has it."""
    aggs, finals = [], []
    for p in props:
        has = F.col(p).isNotNull()
        aggs += [
            F.sum(F.when(has, _w() * F.col(p))).alias(f"_mn_{p}_s"),
            F.sum(F.when(has, _w())).alias(f"_mn_{p}_w"),
        ]
        finals.append(ratio(F.col(f"_mn_{p}_s"), F.col(f"_mn_{p}_w")).alias(f"{prefix}{p}{suffix}"))
    return Block(aggs, finals)


def stats_block(props: list[str]) -> Block:
    """Per property: weighted mean, and plain min, max and range of the elements."""
    mean = mean_block(props)
    aggs = mean.aggs + [f(p).alias(f"_st_{p}_{n}") for p in props for n, f in (("lo", F.min), ("hi", F.max))]
    finals = []
    for p, m in zip(props, mean.finals):
        lo, hi = F.col(f"_st_{p}_lo"), F.col(f"_st_{p}_hi")
        finals += [m, lo.alias(f"{p}_min"), hi.alias(f"{p}_max"), (hi - lo).alias(f"{p}_range")]
    return Block(aggs, finals)


def literature_block(
    avg_dev: list[str] = (),
    std_dev: list[str] = (),
    mean: list[str] = (),
    maximum: list[str] = (),
    shares: dict[str, tuple[str, str]] | None = None,
    totals: dict[str, str] | None = None,
) -> Block:
    """Weighted deviations, means, maxima, valence shares and totals.

    avg_dev = sum f|x - mean|, std_dev = sqrt(sum f (x - mean)^2) with f the fractions, taken as
    sum a|w x - s| / w^2 and sqrt(sum a (w x - s)^2) / w^1.5 with a the amounts, w and s the sums of a and a x, so that
    whole numbers are divided only once;
    a share is sum(w part) / sum(w whole); a total is sum(amount x). One element
    lacking any property used makes every column of the row NULL.
    """
    shares, totals = shares or {}, totals or {}
    used = sorted({*avg_dev, *std_dev, *mean, *maximum, *totals.values(), *(x for s in shares.values() for x in s)})
    bag = F.array_sort(F.collect_list(F.struct("element", "amount", *used)))
    aggs = [
        bag.alias("_li_bag"),
        F.sum(_w()).alias("_li_w"),
        F.count_if(F.greatest(*[F.col(u).isNull().cast("int") for u in used], F.lit(0)) > 0).alias("_li_gaps"),
    ]
    total = F.col("_li_w")

    def fold(f) -> Column:
        return F.aggregate("_li_bag", F.lit(0.0), lambda s, e: s + e["amount"] * f(e))

    def avg(p: str) -> Column:
        return fold(lambda e: e[p].cast("double")) / total

    def spread(p: str, f) -> Column:
        """Sum of a f(w x - s), the sum s being taken once."""
        one = F.array(fold(lambda e: e[p].cast("double")))
        return F.get(F.transform(one, lambda s: fold(lambda e: f(total * e[p] - s))), F.lit(0))

    cols = [(spread(p, F.abs) / (total * total)).alias(f"avg_dev_{p}") for p in avg_dev]
    cols += [(F.sqrt(spread(p, lambda d: d * d)) / (total * F.sqrt(total))).alias(f"std_dev_{p}") for p in std_dev]
    cols += [avg(p).alias(f"mean_{p}") for p in mean]
    cols += [F.array_max(F.col("_li_bag")[p]).alias(f"maximum_{p}") for p in maximum]
    cols += [ratio(fold(lambda e, a=a: e[a]), fold(lambda e, b=b: e[b])).alias(n) for n, (a, b) in shares.items()]
    cols += [fold(lambda e, p=p: e[p].cast("double")).alias(n) for n, p in totals.items()]
    names = (
        [f"avg_dev_{p}" for p in avg_dev] + [f"std_dev_{p}" for p in std_dev] + [f"mean_{p}" for p in mean]
        + [f"maximum_{p}" for p in maximum] + list(shares) + list(totals)
    )
    return Block(aggs, [F.when(F.col("_li_gaps") == 0, c).alias(n) for c, n in zip(cols, names)])


def physics_block(
    valence: str = "valence", chi: str = "chi", ie: str = "ie", ea: str = "ea",
    pol: str = "polarizability", z: str = "z", f_flag: str = "f_flag",
) -> Block:
    """The physics columns, each with its own missing-value rule.

    Valence sums, Mulliken and the f and Z means count a missing value as 0 without
    renormalising; the electronegativity spread ignores it; the polarizability mean
    turns NULL with it. Parity rounds half to even.
    """
    w = _w()
    zero = lambda c: F.sum(F.coalesce(w * c, F.lit(0.0)))
    aggs = [
        F.sum(w).alias("_ph_w"),
        F.count(F.lit(1)).alias("_ph_n"),
        zero(F.col(valence)).alias("_ph_val"),
        F.max(chi).alias("_ph_chi_hi"),
        F.min(chi).alias("_ph_chi_lo"),
        zero((F.col(ie) + F.col(ea)) / 2).alias("_ph_mul"),
        F.count(pol).alias("_ph_pol_n"),
        F.sum(w * F.col(pol)).alias("_ph_pol"),
        zero(F.col(f_flag)).alias("_ph_f"),
        zero(F.col(z)).alias("_ph_z"),
    ]
    c = F.col
    vpa = ratio(c("_ph_val"), c("_ph_w"))
    finals = [
        F.pmod(F.bround("_ph_val", 0), F.lit(2.0)).alias("phys_parity_odd"),
        vpa.alias("phys_vec_per_atom"),
        F.abs(vpa - 8).alias("phys_dist_octet"),
        F.abs(vpa - 18).alias("phys_dist_18e"),
        F.when(c("_ph_n") == 1, F.lit(0.0)).otherwise((c("_ph_chi_hi") - c("_ph_chi_lo")).cast("double")).alias("phys_max_dchi"),
        ratio(c("_ph_mul"), c("_ph_w")).alias("phys_mulliken_chi"),
        F.when(c("_ph_pol_n") == c("_ph_n"), ratio(c("_ph_pol"), c("_ph_w"))).alias("phys_mean_polarizability"),
        ratio(c("_ph_f"), c("_ph_w")).alias("phys_f_fraction"),
        ratio(c("_ph_z"), c("_ph_w")).alias("phys_mean_Z"),
    ]
    return Block(aggs, finals)


def alt_physics_block(ie: str = "ie", ea: str = "ea", states: str = "states") -> Block:
    """Hardness of the softest atom (NULL if any element lacks a value), share of
    multivalent atoms and weighted span of the common oxidation states
    (``states``: array of ints, empty or NULL counts as 0)."""
    w = _w()
    hard = (F.col(ie) - F.col(ea)) / 2
    st = F.col(states)
    multi = F.when(F.size(F.filter(st, lambda s: s > 0)) >= 2, 1.0).otherwise(0.0)
    span = F.coalesce((F.array_max(st) - F.array_min(st)).cast("double"), F.lit(0.0))
    aggs = [
        F.sum(w).alias("_al_w"),
        F.count(F.lit(1)).alias("_al_n"),
        F.count(hard).alias("_al_hn"),
        F.min(hard).alias("_al_h"),
        F.sum(w * multi).alias("_al_m"),
        F.sum(w * span).alias("_al_s"),
    ]
    c = F.col
    return Block(
        aggs,
        [
            F.when(c("_al_hn") == c("_al_n"), c("_al_h")).alias("phys_hardness_min"),
            ratio(c("_al_m"), c("_al_w")).alias("phys_frac_multivalent"),
            ratio(c("_al_s"), c("_al_w")).alias("phys_oxstate_span"),
        ],
    )


# The blocks each tier stacks.
TIERS = {
    "fractions": ("fractions",),
    "literature": ("literature",),
    "standard": ("fractions", "literature"),
    "physics": ("fractions", "literature", "physics"),
    "physics-alt": ("fractions", "literature", "alt"),
}


def build_tier(comp: DataFrame, props: DataFrame, tier: str, blocks: dict[str, Block]) -> DataFrame:
    """Feature table of a tier in a single grouping; an unknown tier raises."""
    if tier not in TIERS:
        raise ValueError(f"unknown feature tier {tier!r}")
    return build_blocks(comp, props, [blocks[b] for b in TIERS[tier]])


def describe_exact(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, stddev, min, exact quartiles and max per column, one row per column."""
    from assayframe.operators.ranking import exact_quantiles

    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]))
    )
    base = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    q = exact_quantiles(long, ["feature"], "value", [0.25, 0.5, 0.75])
    wide = q.groupBy("feature").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    )
    return base.join(wide, "feature", "left")
