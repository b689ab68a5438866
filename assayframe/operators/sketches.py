"""Quantiles from mergeable sketches.

One pass makes a KLL sketch for each part of a table and feature: a few kilobytes whatever the part's size. Sketches of parts are stored
and merged, so that a new part costs a pass over that part, and no value is shuffled or sorted. A quantile's rank is off by
at most ``rank_error(k)`` of the rows, at 99 % confidence; where exact quantiles are wanted, ``ranking.exact_quantiles`` gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank_error(k: int) -> float:
    """Normalised rank error of a sketch of size k (published fit for KLL sketches, single quantiles)."""
    return 2.296 / k**0.9021


def sketched(df: DataFrame, columns: list[str], part: Column | str | None = None, k: int = 800) -> DataFrame:
    """(part, feature, n, sum, low, high, sketch): one row a part and feature. Missing values and NaN are left out; a feature
    without values has a row with n = 0 and no sketch."""
    part = F.lit("all") if part is None else (F.col(part) if isinstance(part, str) else part)
    number = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    named = df.select(part.cast("string").alias("part"), *[number(c).alias(f"v{i}") for i, c in enumerate(columns)])
    aggs = [
        F.struct(
            F.lit(c).alias("feature"), F.count(f"v{i}").alias("n"), F.sum(f"v{i}").alias("sum"), F.min(f"v{i}").alias("low"), F.max(f"v{i}").alias("high"),
            F.when(F.count(f"v{i}") > 0, F.kll_sketch_agg_double(f"v{i}", k)).alias("sketch"),
        )
        for i, c in enumerate(columns)
    ]
    return named.groupBy("part").agg(F.array(*aggs).alias("_f")).select("part", F.inline("_f"))


def merged(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sketches of parts to one a feature (and ``by``)."""
    return sketches.groupBy(*(by or []), "feature").agg(
        F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch")
    )


def quantiles(sketches: DataFrame, probs: list[float]) -> DataFrame:
    """(columns of the sketches but these, prob, quantile); null for a feature without values."""
    keep = [c for c in sketches.columns if c != "sketch"]
    asked = [F.struct(F.lit(float(p)).alias("prob"), F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))).alias("quantile")) for p in probs]
    return sketches.select(*keep, F.inline(F.array(*asked)))


def describe_sketched(df: DataFrame, columns: list[str], k: int = 800) -> DataFrame:
    """count, mean, min, max and quartiles of each column in one pass; the quartiles are those of the sketch."""
    q = quantiles(merged(sketched(df, columns, k=k)), [0.25, 0.5, 0.75])
    wide = [F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name) for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    one = q.groupBy("feature").agg(F.first("n").alias("count"), (F.first("sum") / F.first("n")).alias("mean"), F.first("low").alias("min"), F.first("high").alias("max"), *wide)
    return one
