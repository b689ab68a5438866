"""Clustering that repeats: the same clusters under any partitioning and in any run.

Values are taken as whole multiples of ``unit`` and standardised to whole multiples of 2**-16, so that all sums are sums of
integers and do not depend on their order. The first centre and the next ones are drawn by races of hashes: of all points, the one with the smallest
``-ln(u) / w`` wins, where u is the point's hash as a fraction and w its squared distance to the nearest centre so far; that is
a draw with chances in proportion to w, found by one aggregate a round. A fixed number of steps then moves
the centres to the (rounded down) means of their points. Ties go to the lower centre, and to the lower row_id in a race.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions.draws import draw_hash, hash_int
from assayframe.sources.session import Scratch

GRID = 65_536

Centre = list[int]


def standardised(rows: DataFrame, vector: str, unit: float, row_id: str = "row_id") -> DataFrame:
    """(row_id, z): arrays of whole numbers, GRID to a standard deviation; 0 where a dimension does not vary. Rows
    with a missing vector, another length than most others have, or a value that is no number (or beyond 2**53 units) are left out."""
    units = F.transform(vector, lambda x: F.floor(x.cast("double") / unit + 0.5))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") / unit) < 2.0**53))
    held = rows.select(F.col(row_id).alias("row_id"), F.size(vector).alias("_p"), F.when(fine, units).alias("q")).where("q is not null")
    widths = held.groupBy("_p").count().orderBy(F.desc("count"), "_p").limit(1).first()
    if widths is None:
        return held.select("row_id", F.col("q").alias("z"))
    p = widths["_p"]
    held = held.where(F.col("_p") == p)
    whole = lambda i: F.get("q", F.lit(i)).cast("decimal(18,0)")
    sums = held.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(whole(i)).alias(f"s{i}") for i in range(p)],
        *[F.sum(whole(i) * whole(i)).alias(f"t{i}") for i in range(p)],
    ).first()
    n = sums["n"]
    mean = [float(int(sums[f"s{i}"])) / n for i in range(p)]
    # n * sum of squares - square of the sum, in whole numbers
    spread = [float(n * int(sums[f"t{i}"]) - int(sums[f"s{i}"]) ** 2) ** 0.5 / n for i in range(p)]
    scale = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(s).alias("s")) for m, s in zip(mean, spread)])
    z = F.zip_with("q", scale, lambda x, c: F.when(c["s"] > 0, F.floor((x - c["m"]) / c["s"] * GRID + 0.5)).otherwise(F.lit(0)).cast("long"))
    return held.select("row_id", z.alias("z"))


def _literal(centre: Centre) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in centre])


def _squared(z: Column, centre: Column) -> Column:
    return F.aggregate(F.zip_with(z, centre, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, v: s + v)


def seeds(points: DataFrame, k: int, seed: int) -> list[Centre]:
    """Up to k distinct centres (fewer if there are fewer distinct points)."""
    far = F.lit(1).cast("long")
    centres: list[Centre] = []
    for r in range(k):
        u = (hash_int(draw_hash(seed, f"centre/{r}", "row_id"), 8).cast("double") + 0.5) / 2.0**32
        if centres:
            far = F.array_min(F.array(*[_squared(F.col("z"), _literal(c)) for c in centres]))
        race = F.when(far > 0, -F.log(u) / far.cast("double"))
        won = points.select("row_id", "z", race.alias("key")).where("key is not null").agg(F.min(F.struct("key", "row_id", "z")).alias("w")).first()["w"]
        if won is None:
            break
        centres.append(list(won["z"]))
    return centres


def nearest(centres: list[Centre]) -> Column:
    """Number of the nearest centre of ``z``."""
    return F.array_min(F.array(*[F.struct(_squared(F.col("z"), _literal(c)).alias("d"), F.lit(j).alias("j")) for j, c in enumerate(centres)]))["j"]


def moved(points: DataFrame, centres: list[Centre]) -> list[Centre]:
    """The means of the points of each centre, rounded down; a centre without points stays."""
    p = len(centres[0])
    sums = points.select(nearest(centres).alias("j"), "z").groupBy("j").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("z", F.lit(i))).alias(f"s{i}") for i in range(p)])
    out = list(centres)
    for r in sums.collect():  # one row a centre
        out[r["j"]] = [r[f"s{i}"] // r["n"] for i in range(p)]
    return out


def clusters(rows: DataFrame, vector: str, k: int, seed: int = 42, steps: int = 10, unit: float = 1e-6, scratch: Scratch | None = None) -> tuple[DataFrame, list[Centre]]:
    """(row_id, z, cluster) and the centres after the last step, in units of 1/GRID standard deviations from the mean. The steps end early
    when no centre moves."""
    points = (scratch or Scratch()).settle(standardised(rows, vector, unit), "standardised")
    centres = seeds(points, k, seed)
    for _ in range(steps if centres else 0):
        before, centres = centres, moved(points, centres)
        if before == centres:
            break
    label = nearest(centres) if centres else F.lit(None).cast("int")
    return points.withColumn("cluster", label), centres


def farthest(centres: list[Centre]) -> int:
    """The centre farthest from the mean of all points, which is zero; of equals the first."""
    return max(range(len(centres)), key=lambda j: (sum(v * v for v in centres[j]), -j))
