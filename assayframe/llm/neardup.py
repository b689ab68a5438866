"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

Sketch of a set (``coordinates`` bins): in rounds, every element is hashed to a bin with a value of
round plus fraction; a bin keeps its least value, and rounds go on until each bin is filled. From
round ``coordinates`` on, all elements are thrown at the one bin of that round, so that every
coordinate fills by round twice ``coordinates`` even for a set of one. Large sets need one or two rounds.

Documents with the same set are one class, represented by its smallest doc_id. Classes meet in
buckets of bands (``rows`` coordinates each). With 42 bands of 6 a pair of similarity 0.8 shares
a bucket with probability 1 - 3e-6. Links are confirmed on whole sets, in rounds:

1. each class with the class of another component in its buckets that meets most others (the origin of many
   copies); links found merge into components, and a pair is tried once;
2. when a round finds nothing new, or after ``rounds``: the classes that still share a bucket with another component.
   Those with the same partner in the first round are a family around it; each is kept as its deviations from this head, and
   families are compared block by block with one product of small matrices, of which only links come out. Pairs of
   different families in a bucket are few and are confirmed one by one.

So a large group costs a few pairs a member and nothing lists all its pairs, while no link that a
bucket can show is lost. A pair whose sketches agree in less than ``least_agreement`` of the coordinates (six
standard deviations below the threshold) is not a candidate.

Defined cases: null or empty text has an empty set and links to nothing; with fewer than ``words`` words the whole
sequence is the one shingle; repeated rows are copies of each other; rows without a doc_id
are linked with nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import per_row
from assayframe.sources.session import Scratch, release, settle

MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Near:
    """Parameters: words in a shingle, similarity in per cent, bands and coordinates in a band, rounds with pivots, members in a block."""

    words: int = 4
    percent: int = 80
    bands: int = 42
    rows: int = 6
    least_agreement: float = 0.65
    rounds: int = 3
    block: int = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salts(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Shingler:
    """Sets of hashed shingles; hashes of words met before are looked up."""

    def __init__(self, words: int, most: int = 150_000):
        self.words, self.most = words, most
        self.known: dict[bytes, int] = {}
        self.factors = salts(words) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(words))
        n = len(words) - k + 1
        total = reduce(np.add, (hashes[i : n + i] * self.factors[i] for i in range(k)))
        return np.unique(mix(total + np.uint64(k)))


class Sketcher:
    def __init__(self, near: Near):
        self.t = near.bands * near.rows
        self.near = near
        self.salt = salts(2 * self.t)
        self.band_salt = salts(near.bands) | np.uint64(1)

    def coordinates(self, items: np.ndarray) -> np.ndarray:
        """Round in the top 16 bits, fraction below."""
        t, empty = self.t, np.uint64(MASK)
        found = np.full(t, empty)
        at, step = 0, max(1, -(-3 * t // len(items)))
        while at < t and (found == empty).any():
            rounds = np.arange(at, min(t, at + step), dtype=np.uint64)
            h = mix(items[None, :] ^ self.salt[at : at + len(rounds), None])
            value = (rounds[:, None] << np.uint64(48)) | (h >> np.uint64(16))
            np.minimum.at(found, (h % np.uint64(t)).astype(np.intp).ravel(), value.ravel())
            at += len(rounds)
        for b in np.flatnonzero(found == empty):
            h = mix(items ^ self.salt[t + b])
            found[b] = (np.uint64(t + b) << np.uint64(48)) | (h >> np.uint64(16)).min()
        return found

    def __call__(self, items: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Hash of each band; the lowest byte of each coordinate."""
        coordinates = mix(self.coordinates(items))
        parts = coordinates.reshape(self.near.bands, self.near.rows)
        hashed = self.band_salt.copy()
        for r in range(self.near.rows):
            hashed = mix(hashed * np.uint64(0x9E3779B97F4A7C15) + parts[:, r])
        return hashed.view(np.int64), coordinates.astype(np.uint8).tobytes()


def sketches(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, n_shingles, set_key (hash of the set), bands, sketch; the last three null for an empty set."""

    def make():
        shingle, sketch = Shingler(near.words), Sketcher(near)

        def compute(texts: list) -> tuple[list, ...]:
            rows = []
            for text in texts:
                items = shingle(text)
                key = hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None
                rows.append((len(items), key, *(sketch(items) if len(items) else (None, None))))
            return tuple([r[i] for r in rows] for i in range(4))

        return compute

    added = {"n_shingles": "long", "set_key": "binary", "bands": "array<long>", "sketch": "binary"}
    return per_row(docs, ["doc_id"], ["text"], make, added)


def whole_sets(docs: DataFrame, nodes: DataFrame, near: Near) -> DataFrame:
    """node, items (the sorted set as bytes) of the documents that are nodes."""

    def make():
        shingle = Shingler(near.words)
        return lambda texts: ([shingle(t).tobytes() for t in texts],)

    wanted = docs.select(F.col("doc_id").alias("node"), "text").join(nodes, "node", "left_semi")
    return per_row(wanted, ["node"], ["text"], make, {"items": "binary"}).where(F.length("items") > 0)


def _agreeing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        share = [float((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).mean()) for x, y in zip(frame["x"], frame["y"])]
        yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "share": np.array(share, float)})


def _similar(percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for x, y in zip(frame["x"], frame["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield frame.loc[np.array(keep, bool), ["a", "b"]]

    return run


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, near: Near, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b) that are linked."""

    def beside(df: DataFrame, side: DataFrame, value: str, end: str, name: str) -> DataFrame:
        return df.join(side.select(F.col("node").alias(end), F.col(value).alias(name), *([F.col("n").alias("n" + end)] if value == "sketch" else [])), end)

    close = beside(beside(pairs, classes, "sketch", "a", "x"), classes, "sketch", "b", "y")
    sizes = 100 * F.least("na", "nb") >= near.percent * F.greatest("na", "nb")
    likely = close.where(sizes).select("a", "b", "x", "y").mapInPandas(_agreeing, "a long, b long, share double")
    likely = scratch.settle(likely.where(F.col("share") >= near.least_agreement).select("a", "b"), "near-likely")
    full = beside(beside(likely, sets, "items", "a", "x"), sets, "items", "b", "y")
    return full.mapInPandas(_similar(near.percent), "a long, b long")


def _starred(ends: DataFrame) -> bool:
    """Has every larger end one smaller end, which is no larger end itself? A round would change nothing then."""
    sides = F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    met = ends.select(F.inline(sides)).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not met.where("up > 1 OR (up > 0 AND down > 0)").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that can be reached. Alternates stars of larger and of smaller neighbours until
    only stars are left; every round is a written table, so a lost executor costs the round at most."""
    ends = settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-edges")
    while not _starred(ends):
        both = ends.select(F.col("a").alias("u"), F.col("b").alias("v")).union(ends.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.union(large.select("v", "u")).where("v < u").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m")).where("a <> b")
        after = settle(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-edges")
        release(ends)
        ends = after
    return ends.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _deviations(head: list, items: list) -> tuple[list, list]:
    """Places of the head's shingles that a set lacks, and the shingles that it has instead."""
    lacks, extra = [], []
    for h, x in zip(head, items):
        h, x = np.frombuffer(h, np.uint64), np.frombuffer(x, np.uint64)
        lacks.append(np.flatnonzero(~np.isin(h, x, assume_unique=True)).astype(np.uint64).tobytes())
        extra.append(np.setdiff1d(x, h, assume_unique=True).tobytes())
    return lacks, extra


def _compare_blocks(percent: int):
    """Links between the members of two blocks of a family, from what they have in common in deviating from its head:
    the common part of two sets is the head, less what either lacks, plus what both lack, plus what both have extra."""

    def side(frame: pd.DataFrame) -> tuple[np.ndarray, ...]:
        lacks = [np.frombuffer(d, np.uint64) for d in frame["lacks"]]
        extra = [np.frombuffer(d, np.uint64) | np.uint64(1 << 63) for d in frame["extra"]]
        n_lacks, n_extra = np.array([len(d) for d in lacks], np.int64), np.array([len(d) for d in extra], np.int64)
        return np.repeat(np.arange(2 * len(frame)) % len(frame), np.concatenate((n_lacks, n_extra))), np.concatenate([*lacks, *extra]), n_lacks, n_extra

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = frame[frame["own"] == frame["i"]], frame[frame["own"] == frame["j"]]
        out = pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        if not len(left) or not len(right):
            return out
        row_x, token_x, lacks_x, extra_x = side(left)
        row_y, token_y, lacks_y, extra_y = side(right)
        both = np.intersect1d(token_x, token_y)
        shared = []
        for rows, tokens, n in ((row_x, token_x, len(left)), (row_y, token_y, len(right))):
            at = np.minimum(np.searchsorted(both, tokens), max(0, len(both) - 1))
            hit = both[at] == tokens if len(both) else np.zeros(len(tokens), bool)
            grid = np.zeros((n, len(both)), np.float32)
            grid[rows[hit], at[hit]] = 1
            shared.append(grid)
        head = int(frame["head_size"].iloc[0])
        common = head - lacks_x[:, None] - lacks_y[None, :] + (shared[0] @ shared[1].T).astype(np.int64)
        size_x, size_y = head - lacks_x + extra_x, head - lacks_y + extra_y
        linked = 100 * common >= percent * (size_x[:, None] + size_y[None, :] - common)
        label_x, label_y = left["label"].to_numpy(), right["label"].to_numpy()
        x, y = np.nonzero(linked & (label_x[:, None] != label_y[None, :]))
        # one link tells as much as many between the same two components
        _, one = np.unique(np.stack((label_x[x], label_y[y])), axis=1, return_index=True)
        x, y = left["node"].to_numpy()[x[one]], right["node"].to_numpy()[y[one]]
        return pd.DataFrame({"a": np.maximum(x, y), "b": np.minimum(x, y)})

    return run


def family_links(members: DataFrame, sets: DataFrame, near: Near, scratch: Scratch) -> DataFrame:
    """Links between members (node, label, head) of one family, without a row for each pair: a member is stored as its deviations
    from the head, families are compared block by block, and only links come out."""
    blocks = members.groupBy("head").agg(F.ceil(F.count("*") / near.block).cast("int").alias("blocks"))
    heads = sets.select(F.col("node").alias("head"), F.col("items").alias("head_items"))
    known = members.join(blocks, "head").join(heads, "head").join(sets, "node")
    known = known.withColumn("head_size", F.length("head_items") / 8)
    known = per_row(known, ["node", "label", "head", "blocks", "head_size"], ["head_items", "items"], lambda: _deviations, {"lacks": "binary", "extra": "binary"})
    known = scratch.settle(known.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "near-deviations")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = known.withColumn("other", other).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return dealt.groupBy("head", "i", "j").applyInPandas(_compare_blocks(near.percent), "a long, b long")


def classes_of(table: DataFrame) -> DataFrame:
    return table.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"))


def linked(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    docs, scratch = docs.select("doc_id", "text"), Scratch()
    table = settle(sketches(docs, near), "near-sketches")
    names = settle(classes_of(table), "near-classes")
    own = table.join(names.select(F.col("node").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi")
    classes = scratch.settle(own.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "bands", "sketch"), "near-nodes")
    entries = classes.select("node", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("bucket")
    buckets = scratch.settle(entries.join(shared, "bucket"), "near-buckets")
    sets = scratch.settle(whole_sets(docs, buckets.select("node").distinct(), near), "near-sets")
    slim = classes.drop("bands")

    links = None
    labels = None
    tried = families = None
    # how many others a class meets in its buckets: the origin of many copies meets the most
    met = buckets.groupBy("bucket").agg(F.count("*").alias("size"))
    central = scratch.settle(buckets.join(met, "bucket").groupBy("node").agg(F.sum("size").alias("met")), "near-central")
    order = F.struct(F.col("met"), (-F.col("node")).alias("minus"))
    placed = scratch.settle(buckets.join(central, "node").select("bucket", "node", order.alias("order")), "near-placed")
    for _ in range(near.rounds):
        named = _labelled(placed, labels)
        if labels is not None:  # buckets of one component show nothing new
            open_ = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
            named = scratch.settle(named.join(open_, "bucket"), "near-open")
        # of each component in a bucket its most central class; of each class the most central one of another component
        heads = named.groupBy("bucket", "label").agg(F.max("order").alias("order"))
        first = heads.groupBy("bucket").agg(F.max(F.struct("order", "label")).alias("first"))
        second = heads.join(first, "bucket").where(F.col("label") != F.col("first.label")).groupBy("bucket").agg(F.max("order").alias("second"))
        pivots = first.join(second, "bucket", "left").select("bucket", F.col("first.order").alias("one"), F.col("first.label").alias("to"), "second")
        partner = F.when(F.col("label") != F.col("to"), F.col("one")).otherwise(F.col("second"))
        if labels is None:
            partner = F.when(F.col("order") != F.col("one"), F.col("one"))
        pairs = named.join(pivots, "bucket").select("node", partner.alias("partner")).where("partner IS NOT NULL")
        pairs = pairs.withColumn("pivot", -F.col("partner.minus"))
        pairs = pairs.select("partner", F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b"), "node")
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        best = scratch.settle(pairs.groupBy("node").agg(F.max(F.struct("partner", "a", "b")).alias("p")), "near-pairs")
        if families is None:
            families = best.select("node", (-F.col("p.partner.minus")).alias("head"))
        pairs = best.select("p.a", "p.b").distinct()
        tried = pairs if tried is None else tried.union(pairs)
        found = scratch.settle(confirmed(pairs, slim, sets, near, scratch), "near-links")
        fresh = found.limit(1).count()
        links = found if links is None else scratch.settle(links.union(found), "near-links")
        if fresh or labels is None:
            labels = components(links)
        if not fresh:
            break
    named = _labelled(buckets, labels)
    mixed = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    named = named.join(mixed, "bucket", "left_semi").join(families, "node", "left")
    left = scratch.settle(named.withColumn("head", F.coalesce("head", "node")), "near-rest")
    inside = scratch.settle(family_links(left.select("node", "label", "head").distinct(), sets, near, scratch), "near-links")
    links = scratch.settle(links.union(inside), "near-links")
    sizes = left.groupBy("bucket", "head").agg(F.count("*").alias("size"))
    main = sizes.groupBy("bucket").agg(F.count("*").alias("heads"), F.max(F.struct("size", "head"))["head"].alias("main")).where("heads > 1")
    across = left.join(main, "bucket")
    others = across.where("head <> main").select("bucket", F.col("node").alias("x"), F.col("label").alias("lx"), F.col("head").alias("hx"))
    rest = across.join(others, "bucket").where("label <> lx AND head <> hx").select(F.greatest("node", "x").alias("a"), F.least("node", "x").alias("b"))
    rest = scratch.settle(rest.distinct().join(tried, ["a", "b"], "left_anti"), "near-pairs")
    found = scratch.settle(confirmed(rest, slim, sets, near, scratch), "near-links")
    labels = components(links.union(found))
    scratch.release()

    of_class = names.join(labels, "node", "left").select("set_key", F.coalesce("label", "node").alias("class_label"))
    component = F.coalesce("class_label", "doc_id")
    return (
        table.select("doc_id", "n_shingles", "set_key")
        .join(of_class, "set_key", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _labelled(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """With the component of each node, itself where it has no link yet."""
    if labels is None:
        return buckets.withColumn("label", F.col("node"))
    return buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


SQL = r"""
WITH RECURSIVE seq AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM seq),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets WHERE doc_id IS NOT NULL),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM items x JOIN items y ON x.g = y.g AND x.doc_id > y.doc_id
    GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT reach.doc_id, ends.b FROM reach JOIN ends ON reach.other = ends.a),
least_one AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM sets LEFT JOIN least_one USING (doc_id)
"""
