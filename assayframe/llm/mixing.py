"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The words of a source are dealt to shards (a hot source has many), each shard is a
stream of documents in hash order, cut into blocks of ``block_words`` words. The
seats, one a block, go to the shards by highest quotients ``target / (2k - 1)``, and
a shard with more seats than blocks takes every block once before any twice. Which
blocks get the odd seat is decided by a seeded permutation of the block numbers, so
a rerun agrees and nothing is ranked or listed.

``whole`` turns the words taken of each document into whole copies, such that the words put out of a shard meet the
words taken: documents from long to short, each at one of the two whole numbers around its quota, a seeded
start deciding from which debt on it is the upper one.

Defined cases: null text has size 0 and takes 0; a null source is a source of its own,
last in order; repeated rows are separate documents; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayframe.llm.common import word_count
from assayframe.sources.session import settle

#: Large prime above any number of blocks in a shard, so that it has no factor in common with it.
STEP = 2_147_483_647


@dataclass(frozen=True)
class Mix:
    """Parameters. ``weights`` repeat over the sources in order; ``share`` is the size of the mix
    against all words; ``most`` how often a word may be taken; ``max_shards`` bounds the shards beyond one a source."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    block_words: int = 128
    shard_words: int = 250_000
    max_shards: int = 100_000
    seed: str = "mix"


def draw(seed: str, *parts: Column) -> Column:
    """A 32-bit number from the md5 of the parts."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        F.col("source").isNull().alias("no_source"),
        F.coalesce(F.col("source"), F.lit("")).alias("source_key"),
        word_count(F.col("text")).alias("size"),
    )


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """One row a source: number, size, documents, target. Sources are filled in the order in which they
    reach their limit; the first level at which the next one is not full is the level of all the rest."""
    totals = sizes.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy("no_source", "source_key")
    weight = F.element_at(F.array(*[F.lit(w) for w in mix.weights]), ((F.col("source_no") - 1) % len(mix.weights) + 1).cast("int"))
    everything = Window.partitionBy()
    filled = Window.orderBy("full_at", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    level = (mix.share * F.col("all_words") - mix.most * F.col("filled_size")) / (F.col("all_weight") - F.col("filled_weight"))
    levels = (
        totals.withColumn("source_no", F.row_number().over(order))
        .withColumn("weight", weight)
        .withColumn("full_at", mix.most * F.col("source_size") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("filled_size", F.coalesce(F.sum("source_size").over(filled), F.lit(0)))
        .withColumn("filled_weight", F.coalesce(F.sum("weight").over(filled), F.lit(0)))
        .withColumn("level", level)
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source_no", "level"))).over(everything)["level"])
    )
    target = F.least(mix.most * F.col("source_size").cast("double"), F.col("level") * F.col("weight"))
    return levels.select("no_source", "source_key", "source_no", "source_size", "n_docs", target.alias("target"))


def shards(sizes: DataFrame, sources: DataFrame, mix: Mix) -> DataFrame:
    """Documents with their shard and the place of their first word in it. Shards count words and documents, so
    that a source of empty documents is split as well."""
    total = sources.agg(F.sum(F.col("source_size") + F.col("n_docs")).alias("total"))
    width = F.greatest(F.lit(mix.shard_words), F.ceil(F.col("total") / mix.max_shards))
    parts = F.greatest(F.lit(1), F.ceil((F.col("source_size") + F.col("n_docs")) / width))
    named = sources.join(F.broadcast(total)).select("no_source", "source_key", "source_no", "source_size", "target", parts.alias("n_shards"))
    dealt = (
        sizes.join(named, ["no_source", "source_key"])
        .withColumn("drawn", draw(mix.seed, F.col("doc_id")))
        .withColumn("shard", F.col("drawn") % F.col("n_shards"))
    )
    before = Window.partitionBy("source_no", "shard").orderBy("drawn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0))).select(
        "doc_id", "source_no", "shard", "size", "source_size", "target", "first"
    )


def apportion(cells: DataFrame, mix: Mix) -> DataFrame:
    """Seats of each shard (``share`` is its target in words, ``blocks`` its blocks).

    Highest quotients are those above a divisor: the divisor is narrowed by one aggregate over the shards for a
    grid of candidates at a time, until it parts all but a few quotients; these few are ordered, ties by source and shard.
    """
    limit = mix.most * F.col("blocks")

    def seats(divisor: float) -> Column:
        return F.least(limit, F.floor(F.col("share") / F.lit(divisor) + 0.5))

    words = cells.agg(F.sum("share")).first()[0] or 0.0
    wanted = int(words / mix.block_words + 0.5)
    low, high = mix.block_words / 1e6, mix.block_words * 1e6
    for _ in range(14):
        grid = [low * (high / low) ** (k / 32) for k in range(33)]
        counts = cells.agg(*[F.sum(seats(d)).alias(f"c{k}") for k, d in enumerate(grid)]).first()
        counts = [c or 0 for c in counts]
        at = max((k for k in range(33) if counts[k] >= wanted), default=0)
        low, high = grid[at], grid[min(at + 1, 32)]
        if counts[at] - counts[min(at + 1, 32)] <= 64 and at < 32 or counts[at] == wanted:
            break
    left = wanted - counts[min(at + 1, 32)]
    held = cells.withColumn("seats", seats(high)).withColumn("more", seats(low) - seats(high))
    steps = F.explode(F.sequence(F.lit(1), F.col("more").cast("int")))
    open_ = held.where("more > 0").select("source_no", "shard", "share", "seats", steps.alias("step"))
    ranked = open_.orderBy((F.col("share") / (2 * (F.col("seats") + F.col("step")) - 1)).desc(), "source_no", "shard").limit(max(0, left))
    won = ranked.groupBy("source_no", "shard").agg(F.count("*").alias("won"))
    return held.join(won, ["source_no", "shard"], "left").select(
        "source_no", "shard", "blocks", (F.col("seats") + F.coalesce("won", F.lit(0))).cast("long").alias("seats")
    )


def quotas(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, source_no, shard, size, source_size, target (of the source), taken (words, repeats counted)."""
    sizes = settle(sized(docs), "mix-sizes")
    sources = settle(source_targets(sizes, mix), "mix-sources")
    dealt = settle(shards(sizes, sources, mix), "mix-shards")
    words = dealt.groupBy("source_no", "shard").agg(F.sum("size").alias("words"), F.first("source_size").alias("ss"), F.first("target").alias("target"))
    cells = settle(
        words.where("words > 0").select(
            "source_no",
            "shard",
            F.ceil(F.col("words") / mix.block_words).alias("blocks"),
            (F.col("target") * (F.col("words") / F.col("ss"))).alias("share"),
        ),
        "mix-cells",
    )
    seats = settle(apportion(cells, mix), "mix-quotas")
    width, blocks = F.lit(mix.block_words), F.col("blocks")
    start, end = F.col("first"), F.col("first") + F.col("size")
    turn = draw(mix.seed, F.col("source_no"), F.col("shard"))

    def words_of(total: Column, k: Column) -> Column:
        shared = F.least(F.col("end"), (k + 1) * width) - F.greatest(F.col("first"), k * width)
        place = (k * (F.lit(STEP) % blocks) + F.col("turn")) % blocks
        copies = F.floor(F.col("seats") / blocks) + F.when(place < F.col("seats") % blocks, 1).otherwise(0)
        return total + shared * copies

    spans = F.sequence(F.floor(start / width), F.floor((F.col("end") - 1) / width))
    taken = F.when((F.col("size") > 0) & F.col("seats").isNotNull(), F.aggregate(spans, F.lit(0).cast("long"), words_of)).otherwise(F.lit(0))
    return (
        dealt.join(seats, ["source_no", "shard"], "left")
        .withColumn("end", end)
        .withColumn("turn", turn)
        .select("doc_id", "source_no", "shard", "size", "source_size", "target", taken.cast("long").alias("taken"))
    )


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target (of the source), taken (words, repeats counted)."""
    return quotas(docs, mix).select("doc_id", "size", "source_size", "target", "taken")


def rounded(sizes: np.ndarray, taken: np.ndarray, start: float) -> np.ndarray:
    """Copies of documents in order from long to short. What the quotas are ahead of the words put out is carried
    along; a document with a part of a copy open gets it if that debt reaches ``start`` of its size."""
    copies, debt = taken // sizes, 0
    for i, (size, rest) in enumerate(zip(sizes.tolist(), (taken % sizes).tolist())):
        if rest:
            debt += rest
            if debt >= start * size:
                copies[i] += 1
                debt -= size
    return copies


def _whole(shard: pd.DataFrame) -> pd.DataFrame:
    shard = shard.sort_values(["size", "drawn", "doc_id", "taken"], ascending=[False, True, True, True], kind="stable")
    copies = rounded(shard["size"].to_numpy(np.int64), shard["taken"].to_numpy(np.int64), float(shard["start"].iloc[0]))
    return pd.DataFrame({"doc_id": shard["doc_id"], "copies": copies})


def whole(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id (a long, not null), copies, for each document with words. A shard (``shard_words``) is rounded by one task."""
    drawn = draw(mix.seed, F.col("doc_id")).alias("drawn")
    start = ((draw(f"{mix.seed}:start", F.col("source_no"), F.col("shard")) + 0.5) / 2.0**32).alias("start")
    open_ = quotas(docs, mix).where("size > 0").select("doc_id", "source_no", "shard", "size", "taken", drawn, start)
    return open_.groupBy("source_no", "shard").applyInPandas(_whole, "doc_id long, copies long")


SQL = r"""
WITH sizes AS (SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source_key,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT no_source, source_key, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sizes GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (ORDER BY no_source, source_key) AS source_no FROM totals),
weighed AS (SELECT *, CASE (source_no - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM numbered),
filled AS (SELECT *, 2 * source_size / weight AS full_at, sum(source_size) OVER () AS all_words, sum(weight) OVER () AS all_weight FROM weighed),
levels AS (SELECT *, (1.5 * all_words::DOUBLE - 2 * coalesce(sum(source_size) OVER w, 0)::DOUBLE)
    / (all_weight - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level FROM filled
    WINDOW w AS (ORDER BY full_at, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT level FROM levels WHERE level <= full_at ORDER BY full_at, source_no LIMIT 1),
targets AS (SELECT no_source, source_key, source_no, source_size, n_docs, least(2.0 * source_size::DOUBLE, chosen.level * weight) AS target,
    greatest(1, ceil((source_size + n_docs) / greatest(250000, ceil((SELECT sum(source_size + n_docs) FROM totals) / 100000))))::BIGINT AS n_shards
    FROM levels, chosen),
drawn AS (SELECT doc_id, size, source_no, source_size, target, n_shards, ('0x' || md5('mix:' || coalesce(doc_id::VARCHAR, 'null'))[1:8])::BIGINT AS d
    FROM sizes JOIN targets USING (no_source, source_key)),
dealt AS (SELECT *, d % n_shards AS shard FROM drawn),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source_no, shard ORDER BY d, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM dealt),
cells AS (SELECT source_no, shard, ceil(sum(size) / 128)::BIGINT AS blocks, any_value(target) * (sum(size)::DOUBLE / any_value(source_size)::DOUBLE) AS share
    FROM placed GROUP BY ALL HAVING sum(size) > 0),
ranked AS (SELECT source_no, shard, row_number() OVER (ORDER BY share / (2 * k - 1) DESC, source_no, shard) AS place
    FROM (SELECT *, unnest(range(1, 2 * blocks + 1)) AS k FROM cells)),
seats AS (SELECT source_no, shard, count(*) FILTER (WHERE place <= (SELECT floor(sum(share) / 128 + 0.5) FROM cells)) AS seats FROM ranked GROUP BY ALL),
quotas AS (SELECT source_no, shard, blocks, seats, ('0x' || md5('mix:' || source_no || ':' || shard)[1:8])::BIGINT AS turn
    FROM cells JOIN seats USING (source_no, shard))
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN coalesce(list_sum(list_transform(range(first // 128, (first + size - 1) // 128 + 1),
    lambda k: (least(first + size, (k + 1) * 128) - greatest(first, k * 128))
      * (seats // blocks + CASE WHEN (k * (2147483647 % blocks) + turn) % blocks < seats % blocks THEN 1 ELSE 0 END))), 0) ELSE 0 END::BIGINT AS taken
FROM placed LEFT JOIN quotas USING (source_no, shard)
"""
