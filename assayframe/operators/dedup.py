"""De-duplication: exact by key, and greedy under an earth-mover distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from assayframe.operators import cells
from assayframe.operators.ranking import global_rank
from assayframe.sources.session import settle

DEFAULT_THRESHOLD = 5.0  # curation
ARM_THRESHOLD = 0.5  # training arms
_DIGITS = cells.DIGITS
_UNROLL = 48
_SMALL_BYTES = 64 << 20  # tiles of points up to this size in all are not divided
_LEAST_PAIRS, _PAIRS_A_POINT = 16_000_000, 40  # near pairs of a prefix
_CROWD = 4  # near pairs for a pair in one cell
_HOT_MIN = 20_000  # tiles up to this many points are never salted
_CELLS = 1 << 21  # numbers that a task sets out at a time


def one_per_key(df: DataFrame, key: str, prefer_min: str | None, row_id: str) -> DataFrame:
    """One row per key: the lowest ``prefer_min`` (NULLs last, ties by row_id), or the
    lowest row_id without it. NULL keys are dropped. ``min_by`` combines map-side, so a
    key holding most rows is reduced to one row per task before the shuffle."""
    df = df.where(F.col(key).isNotNull())
    if prefer_min is not None and prefer_min in df.columns:
        order = F.struct(F.col(prefer_min).isNull(), F.col(prefer_min), F.col(row_id))
    else:
        order = F.struct(F.col(row_id))
    best = df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_r"))
    return best.select(key, "_r.*").select(*df.columns)


@dataclass(frozen=True)
class Scale:
    """A 1-D scale: symbol -> position. The table is a dimension of the vocabulary's size."""

    positions: dict[str, float]

    @classmethod
    def from_table(cls, table: DataFrame) -> "Scale":
        return cls({r["element"]: float(r["position"]) for r in table.select("element", "position").collect()})

    @property
    def steps(self) -> list[tuple[float, float]]:
        """(position, gap to the next position)."""
        ps = sorted(set(self.positions.values()))
        return list(zip(ps, [b - a for a, b in zip(ps, ps[1:])]))

    def place(self, element: Column) -> Column:
        pairs = [x for k, v in self.positions.items() for x in (F.lit(k), F.lit(v))]
        return F.try_element_at(F.create_map(*pairs), element)

    def coordinates(self, bag: dict[str, float]) -> list[float]:
        total = sum(bag.values())
        return [sum(w for e, w in bag.items() if self.positions[e] <= p) / total * gap for p, gap in self.steps]


def _bags(comp: DataFrame, scale: Scale) -> DataFrame:
    """(row_id, num_atoms, bag): position and amount of the elements of a composition, in order. Rows with an element
    outside the scale are left out."""
    placed = comp.withColumn("_pos", scale.place(F.col("element")))
    bags = placed.groupBy("row_id").agg(
        F.sum("amount").alias("num_atoms"),
        F.sort_array(F.collect_list(F.struct(F.col("_pos").alias("p"), F.col("amount").cast("double").alias("w")))).alias("bag"),
        F.count_if(F.col("_pos").isNull()).alias("_stray"),
    )
    return bags.where("_stray = 0 and num_atoms > 0").drop("_stray")


def _shares(bag: pa.ListArray, total: np.ndarray, steps: list[tuple[float, float]]) -> pa.ListArray:
    """Cumulative shares of bags, times the gaps; amounts are added in the order of the bag. Behind a missing amount shares are missing."""
    at, gaps = (np.array(x, float) for x in zip(*steps))
    flat, size = bag.flatten(), bag.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    amounts, first = flat.field("w"), np.cumsum(size) - size
    missing, amounts = amounts.is_null().to_numpy(zero_copy_only=False), amounts.to_numpy(zero_copy_only=False)
    place = np.searchsorted(at, flat.field("p").to_numpy(zero_copy_only=False))
    owner, n, width = np.repeat(np.arange(len(bag)), size), len(bag), len(at)
    below = np.bincount(owner * (width + 1) + place, minlength=n * (width + 1)).reshape(n, width + 1)[:, :width].cumsum(1)
    upto, lost = np.zeros((n, size.max(initial=0) + 1)), np.zeros((n, size.max(initial=0) + 1), bool)
    for k in range(upto.shape[1] - 1):
        has = np.flatnonzero(size > k)
        upto[has, k + 1] = upto[has, k] + amounts[first[has] + k]
        lost[has, k + 1] = lost[has, k] | missing[first[has] + k]
    out = np.take_along_axis(upto, below, 1) / total[:, None] * gaps
    values = pa.array(out.ravel(), mask=np.take_along_axis(lost, below, 1).ravel() if missing.any() else None)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), values)


def _on_scale(bags: DataFrame, scale: Scale) -> DataFrame:
    """Bags as points: ``coords`` in place of ``bag``."""
    steps = scale.steps
    others = [c for c in bags.columns if c != "bag"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longest = pc.max(pc.list_value_length(batch["bag"])).as_py() or 0
            rows = max(1, _CELLS // (longest + len(steps) + 1))
            for start in range(0, batch.num_rows, rows):
                some = batch.slice(start, rows)
                total = some["num_atoms"].cast(pa.float64()).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*(some[c] for c in others), _shares(some["bag"], total, steps)], [*others, "coords"])

    schema = StructType([*(bags.schema[c] for c in others), StructField("coords", ArrayType(DoubleType()))])
    return bags.mapInArrow(place, schema)


def coordinates(comp: DataFrame, scale: Scale) -> DataFrame:
    """(row_id, num_atoms, coords): the composition as a point whose L1 distances are
    earth-mover distances (cumulative share at each position times the gap after it).
    Rows with an element outside the scale are left out."""
    return _on_scale(_bags(comp, scale), scale)


def distance(a: Column, b: Column, width: int) -> Column:
    """L1 distance of two coordinate arrays at nine decimals. Short arrays are
    unrolled so that the sum is compiled with the join that uses it."""
    if width <= _UNROLL:
        d = F.lit(0.0)
        for i in range(width):
            d = d + F.abs(F.get(a, F.lit(i)) - F.get(b, F.lit(i)))
    else:
        d = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.floor(d * _DIGITS + 0.5) / _DIGITS


def pair_distances(pairs: DataFrame, comp: DataFrame, scale: Scale) -> DataFrame:
    """(a, b, distance) for given pairs of row ids."""
    pts = coordinates(comp, scale).select("row_id", "coords")
    left = pts.select(F.col("row_id").alias("a"), F.col("coords").alias("_x"))
    right = pts.select(F.col("row_id").alias("b"), F.col("coords").alias("_y"))
    return pairs.join(left, "a").join(right, "b").select(
        "a", "b", distance(F.col("_x"), F.col("_y"), len(scale.steps)).alias("distance")
    )


class _Grid:
    """Tiles over block sums of the coordinates.

    The sum of |differences of block sums| never exceeds the distance, so a point within
    the threshold of another lies in a tile that the threshold reaches from there. A task
    searches a tile by finer cells (``cells.Cells``).
    """

    def __init__(self, width: int, threshold: float, blocks: int):
        self.width, self.threshold, self.reach = width, threshold, cells.reach_of(threshold)
        self.spans = [(a + 1, b - a) for a, b in cells.spans_of(width, blocks)]
        self.side = 2 * max(self.reach, 1e-6)

    def sums(self, coords: Column) -> Column:
        return _block_sums(coords, self.spans)

    def _index(self, sums: Column) -> list[Column]:
        return [F.floor(F.get(sums, F.lit(i)) / self.side) for i in range(len(self.spans))]

    def key(self, grp: Column, sums: Column) -> Column:
        """64-bit tile key; a collision only adds candidates, which are checked in full."""
        return F.xxhash64(grp, *self._index(sums))

    def around(self, grp: Column, sums: Column) -> Column:
        """Keys of the tiles within reach: the own one and those past borders whose distances add up to no more."""
        idx = self._index(sums)
        over = [F.get(sums, F.lit(i)) - c * self.side for i, c in enumerate(idx)]
        keys = []
        for shifts in product((-1, 0, 1), repeat=len(idx)):
            cost = F.lit(0.0)
            for d, o in zip(shifts, over):
                cost = cost + (o if d < 0 else F.lit(self.side) - o) if d else cost
            key = F.xxhash64(grp, *[c + d for c, d in zip(idx, shifts)])
            keys.append(F.when(cost <= self.reach, key) if any(shifts) else key)
        return F.array_distinct(F.array_compact(F.array(*keys)))

    def crowd(self, coords: Column) -> Column:
        """Key of the cell by which points are searched. Pairs in one cell tell about how many pairs are near."""
        sums = _block_sums(coords, [(a + 1, b - a) for a, b in cells.spans_of(self.width, cells.BLOCKS)])
        return F.xxhash64(F.transform(sums, lambda s: F.floor(s / (self.side * cells.SIDE / 2))))


def _block_sums(coords: Column, spans: list[tuple[int, int]]) -> Column:
    if sum(size for _, size in spans) <= _UNROLL:
        return F.array(*[reduce(lambda s, i: s + F.get(coords, F.lit(i)), range(start - 1, start - 1 + size), F.lit(0.0)) for start, size in spans])
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.array(*[add(F.slice(coords, start, size)) for start, size in spans])


def _hot_cells(points: DataFrame, cap: int) -> DataFrame:
    """Tiles above ``cap`` points and the number of salts each gets."""
    return settle(
        points.groupBy("ck").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cap)
        .select("ck", F.ceil(F.col("_n") / cap).cast("int").alias("_salts")),
        "hot-cells",
    )


def _salted(points: DataFrame, hot: DataFrame | None) -> DataFrame:
    """The side that is divided: each point of a hot tile gets one of its salts."""
    if hot is None:
        return points.withColumn("salt", F.lit(0))
    salts = F.coalesce("_salts", F.lit(1))
    return points.join(hot, "ck", "left").withColumn("salt", F.pmod(F.xxhash64("rank"), salts).cast("int")).drop("_salts")


def _spread(points: DataFrame, n: int) -> int:
    """Partitions for n points of pair work."""
    return max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 20_000)


def _fanned(points: DataFrame, grid: _Grid, hot: DataFrame | None) -> DataFrame:
    """The side that is copied: one row per tile within reach and salt of that tile."""
    named = [F.col(c).alias(f"n_{c}") for c in ("grp", "rank", "coords")]  # a cogroup mixes up columns of one table on both sides
    near = points.select(*named, F.explode(grid.around(F.col("grp"), F.col("sums"))).alias("ck"))
    if hot is None:
        return near.withColumn("salt", F.lit(0))
    salts = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    return near.join(hot, "ck", "left").select("n_grp", "n_rank", "n_coords", "ck", F.explode(salts).alias("salt"))


def _met(fan: DataFrame, plain: DataFrame, grid: _Grid, hot: DataFrame | None, n: int, work, schema: str) -> DataFrame:
    """``work`` on each tile: the points of ``fan`` within its reach and its own of ``plain``. Tiles of inputs that are
    counted to be small are not divided."""
    if n * (grid.width + 12) * 8 <= _SMALL_BYTES:
        hot = None
    near, keys, tasks = ["n_grp", "ck", "salt"], ["grp", "ck", "salt"], _spread(fan, n)
    # The smaller columns first: rows are partitioned by point count, because pair work is heavy per byte.
    left = _fanned(fan.repartition(tasks, "rank"), grid, hot).repartition(tasks, *near)
    right = _salted(plain.select("grp", "rank", "coords", "ck"), hot).repartition(tasks, *keys)
    return left.groupBy(*near).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)


def _near(fan: DataFrame, plain: DataFrame, grid: _Grid, hot: DataFrame | None, n: int) -> DataFrame:
    """(grp, n_rank, rank, d): pairs of a point of ``fan`` (n_rank) and one of ``plain`` within the threshold; of whole-number
    ranks only those with n_rank < rank."""
    width, threshold = grid.width, grid.threshold
    numbered = plain.schema["rank"].dataType.simpleString() in ("int", "bigint")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            left, right = left.slice(0, 0), right.slice(0, 0)
        later = (right["rank"].to_numpy(), left["n_rank"].to_numpy()) if numbered else None
        tree = cells.Cells(cells.matrix(left["n_coords"], width), threshold)
        query, at, d = tree.pairs(cells.matrix(right["coords"], width), later)
        columns = {"grp": right["grp"].take(query), "n_rank": left["n_rank"].take(at), "rank": right["rank"].take(query), "d": pa.array(d)}
        return pa.table(columns)

    kind = plain.schema["rank"].dataType.simpleString()
    return _met(fan, plain, grid, hot, n, work, f"grp string, n_rank {kind}, rank {kind}, d double")


def _untouched(fan: DataFrame, plain: DataFrame, grid: _Grid, hot: DataFrame | None, n: int) -> DataFrame:
    """(grp, rank, coords, ck) of the points of ``plain`` that no point of ``fan`` is near to."""
    width, threshold = grid.width, grid.threshold

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.select(["grp", "rank", "coords", "ck"])
        if not (left.num_rows and right.num_rows):
            return right
        tree = cells.Cells(cells.matrix(left["n_coords"], width), threshold)
        return right.filter(pa.array(~tree.touched(cells.matrix(right["coords"], width))))

    return _met(fan, plain, grid, hot, n, work, "grp string, rank long, coords array<double>, ck long")


def _scan_edges(edges: pd.DataFrame) -> pd.DataFrame:
    """The greedy rule on a short edge list of one group, vertices in order."""
    gone: set[int] = set()
    ordered = edges.sort_values("hi")
    for hi, lo in zip(ordered["hi"].tolist(), ordered["lo"].tolist()):
        if lo not in gone:  # every edge into lo has been seen, as lo < hi
            gone.add(hi)
    return pd.DataFrame({"grp": edges["grp"].iloc[0], "v": sorted(gone)})


def _independent(edges: DataFrame, left: int, few_edges: int) -> DataFrame | None:
    """Vertices dropped by the greedy rule on an edge table (grp, lo, hi) of ``left`` rows, lo first.

    A vertex without an undecided predecessor is kept and its successors dropped;
    repeated on what is left, this is the sequential greedy choice. Each round is
    written out, so the plan stays short and a lost executor costs one round. Once
    the counted remainder is at most ``few_edges`` in all groups together, each group
    is finished in one scan instead of many rounds over next to nothing.
    """
    dropped = []
    while left:
        if left <= few_edges:
            dropped.append(settle(edges.groupBy("grp").applyInPandas(_scan_edges, "grp string, v bigint"), "dropped"))
            break
        ends = F.array(F.struct(F.col("lo").alias("v"), F.lit(0).alias("late")), F.struct(F.col("hi").alias("v"), F.lit(1).alias("late")))
        roots = edges.select("grp", F.inline(ends)).groupBy("grp", "v").agg(F.max("late").alias("late")).where("late = 0")
        hit = edges.join(roots.select("grp", F.col("v").alias("lo")), ["grp", "lo"], "left_semi")
        hit = settle(hit.select("grp", F.col("hi").alias("v")).distinct(), "dropped")
        dropped.append(hit)
        for end in ("lo", "hi"):
            edges = edges.join(hit.withColumnRenamed("v", end), ["grp", end], "left_anti")
        edges = settle(edges, "edges")
        left = edges.count()
    out = None
    for d in dropped:
        out = d if out is None else out.unionByName(d)
    return out


def greedy_keep(
    comp: DataFrame,
    scale: Scale,
    threshold: float,
    members: DataFrame | None = None,
    seed: tuple[object, dict[str, float]] | None = None,
    drop_first: bool = False,
    blocks: int = 3,
    pair_budget: int | None = None,
    few_edges: int = 100_000,
) -> DataFrame:
    """Greedy redundancy removal: in order of (num_atoms, row_id) keep an item iff its
    distance to every item kept before it exceeds ``threshold``.

    ``comp`` is the long table of distinct items. ``members`` (grp, row_id) runs the
    rule inside each group at once; the result is (grp, row_id), or (row_id) without it.
    ``seed`` = (row_id, {element: amount}) puts an item first whether or not it is in
    the data; ``drop_first`` discards the first item of each group unseen.

    The result is that of the sequential scan for any data, while the work is bounded
    as follows. Points with identical coordinates collapse to the first of them. The
    undecided points are then taken in prefixes of the order: a prefix is the longest
    whose near pairs, as told by cell counts, fit ``pair_budget``, its pairs within the
    threshold are found tile by tile and resolved among themselves, and the points it
    keeps remove everything near them from the rest, for which one of them is enough.
    Dense data therefore shrinks before its pairs are ever formed.
    """
    width = len(scale.steps)
    grid = _Grid(width, threshold, blocks)
    ranked = global_rank(_bags(comp, scale), ["num_atoms", "row_id"])  # bags are narrower than points, and passed over twice
    pts = settle(_on_scale(ranked.withColumn("rank", F.col("rank") + 1), scale), "points")
    if members is None:
        items = pts.withColumn("grp", F.lit("all"))
    else:
        items = members.select(F.col("grp").cast("string").alias("grp"), "row_id").join(pts, "row_id")
    if drop_first:
        first = items.groupBy("grp").agg(F.min("rank").alias("rank"))
        items = items.join(first, ["grp", "rank"], "left_anti")
    kept = None
    if seed is not None:
        name, bag = seed
        here = F.array(*[F.lit(float(x)) for x in scale.coordinates(bag)])
        is_seed = F.col("row_id") == F.lit(name)
        kept = items.where(is_seed).select("grp", "rank")
        items = items.where(~is_seed & (distance(F.col("coords"), here, width) > threshold))

    # Same point, same fate: the first keeps or loses the place for all copies.
    open_ = items.groupBy("grp", "coords").agg(F.min("rank").cast("long").alias("rank"))
    open_ = settle(open_.withColumn("ck", grid.key(F.col("grp"), grid.sums(F.col("coords")))), "open")
    high = pts.agg(F.max("rank")).first()[0] or 0

    parts = [] if kept is None else [kept]
    cut, patience = 1, 1
    while cut <= high:
        n, fullest, cut = _prefix(open_, grid, cut, high, pair_budget, patience)
        if n == 0:
            break
        cap = max(_HOT_MIN, n // 200)
        hot = _hot_cells(open_, cap) if fullest > cap else None
        head = open_.where(F.col("rank") < cut)
        summed = lambda df: df.withColumn("sums", grid.sums(F.col("coords")))
        edges = _near(summed(head), head, grid, hot, n)
        edges = settle(edges.select("grp", F.col("n_rank").alias("lo"), F.col("rank").alias("hi")), "edges")
        n_edges = edges.count()
        dropped = _independent(edges, n_edges, few_edges)
        chosen = head if dropped is None else head.join(dropped.withColumnRenamed("v", "rank"), ["grp", "rank"], "left_anti")
        chosen = settle(chosen, "kept")
        parts.append(chosen.select("grp", "rank"))
        if cut > high:
            break
        rest = open_.where(F.col("rank") >= cut)
        open_ = settle(_untouched(summed(chosen), rest, grid, hot, n), "open")
        # Candidates that seldom are edges mean sparse points: dare a longer prefix.
        patience = min(64, patience * 4) if n_edges < n else patience

    out = parts[0] if parts else items.select("grp", "rank").limit(0)
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.join(pts.select("rank", "row_id"), "rank").select("grp", "row_id")
    return out.select("row_id") if members is None else out


def _prefix(open_: DataFrame, grid: _Grid, low: int, high: int, budget: int | None, patience: int = 1, steps: int = 12) -> tuple[int, int, int]:
    """(points left, points in the fullest tile, rank bound): the largest bound, among
    quarterings of the rank range, whose near pairs, as told by the cells that are searched, fit the budget."""
    bounds = []
    for k in range(steps + 1):
        b = low + max(1, (high - low + 1) >> (2 * k))
        if not bounds or b != bounds[-1]:
            bounds.append(b)
    names = [f"_{i}" for i in range(len(bounds))]
    full = open_.groupBy("ck").count().agg(F.sum("count").alias("n"), F.max("count").alias("fullest")).first()
    n = full["n"] or 0
    if n == 0:
        return 0, 0, bounds[0]
    crowds = open_.groupBy("grp", grid.crowd(F.col("coords"))).agg(*[F.count_if(F.col("rank") < b).alias(c) for c, b in zip(names, bounds)])
    load = crowds.agg(*[F.sum(F.col(c).cast("double") * F.col(c)).alias(c) for c in names]).first()
    budget = (budget or max(_LEAST_PAIRS, _PAIRS_A_POINT * n)) * patience
    fits = [b for c, b in zip(names, bounds) if load[c] * _CROWD <= budget]
    return n, full["fullest"], (fits or bounds[-1:])[0]
