"""Merkle manifest of a table: a tree of hashes a source, a tree over the sources, a proof for every row.

A leaf is the sha256 of a row. The leaves of a source are numbered in order of doc_id, and the digits of the
number to base ``fan`` are the leaf's path. Digits are grouped away one after the other, lowest first: each
grouping puts up to ``fan`` nodes into the struct of their parent, next to its hash. All groupings of a block of ``fan ** digits``
leaves happen where its rows lie, after one shuffle by (source, block), and a block becomes one row with its nested
tree. The roots of the blocks are the leaves of the next round, until a source is one block; the subroots of
the sources go through the same rounds. Proofs are emitted by one nested transform and an explode of each block: a leaf
meets its siblings in the structs around it. Blocks of one round get the steps above them, one row
a block, from the round above.

Defined cases: a null field is hashed as ``-``; rows without doc_id come first in their source and are not tampered with;
rows of one doc_id follow in order of their leaves, equal rows are leaves of their own next to each other; rows without
source are a source of their own, the first; an empty table has no rows and no root; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.operators.ranking import global_rank, running_totals
from assayframe.sources.session import Scratch, settle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class Tree:
    """Parameters: children of a node, digits grouped away in a block."""

    fan: int = 3
    digits: int = 6

    @property
    def block(self) -> int:
        return self.fan**self.digits


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, tampered (the leaf of the row with its line breaks deleted, null where nothing is tampered with)."""
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.col("text").contains("\n")
    other = {"text": F.regexp_replace("text", "\n", "")}
    return docs.select(
        "doc_id",
        "source",
        hashed(*[field(F.col(c)) for c in FIELDS]).alias("leaf"),
        F.when(tampered, hashed(*[field(other.get(c, F.col(c))) for c in FIELDS])).alias("tampered"),
    )


def rolled(items: DataFrame, tree: Tree) -> DataFrame:
    """From (seq, at, n, hash, item): the numbered nodes of each sequence to (seq, block, n, node), where a node is the
    struct of its hash and its children down to the items. A sequence of one node is its own root."""
    digits = [(F.floor(F.col("at") / tree.fan**k) % tree.fan).cast("int").alias(f"d{k}") for k in range(tree.digits)]
    nodes = items.select("seq", F.floor(F.col("at") / tree.block).alias("block"), "n", *digits, F.struct("hash", "item").alias("node"))
    nodes = nodes.repartition("seq", "block")
    for k in range(tree.digits):
        rest = [f"d{j}" for j in range(k + 1, tree.digits)]
        children = F.sort_array(F.collect_list(F.struct(F.col(f"d{k}").alias("digit"), "node")))
        grouped = nodes.groupBy("seq", "block", "n", *rest).agg(F.transform(children, lambda c: c["node"]).alias("kids"))
        own = F.when(F.col("n") > tree.fan**k, hashed(F.array_join(F.transform("kids", lambda c: c["hash"]), ""))).otherwise(F.col("kids")[0]["hash"])
        nodes = grouped.select("seq", "block", "n", *rest, F.struct(own.alias("hash"), "kids").alias("node"))
    return nodes


def rounds(items: DataFrame, tree: Tree, scratch: Scratch) -> list[DataFrame]:
    """The tables of blocks, from the items up to one block a sequence."""
    tables = [scratch.settle(rolled(items, tree), "merkle-blocks")]
    while (tables[-1].agg(F.max("n")).first()[0] or 0) > tree.block:
        above = tables[-1].select(
            "seq", F.col("block").alias("at"), F.ceil(F.col("n") / tree.block).alias("n"), F.col("node.hash").alias("hash"), F.col("block").alias("item")
        )
        tables.append(scratch.settle(rolled(above, tree), "merkle-blocks"))
    return tables


def emitted(blocks: DataFrame, tree: Tree, keep: list[str]) -> DataFrame:
    """From blocks with ``steps`` (hashes before and after a node, level by level above the block) to one row an item: seq,
    ``keep``, hash, item and the steps from the item to the root."""

    def joined(kids: Column, start: Column, length: Column) -> Column:
        return F.array_join(F.transform(F.slice(kids, start, length), lambda s: s["hash"]), "")

    def below(node: Column, height: int, above: Column) -> Column:
        if height == 0:
            return F.array(F.struct(node["hash"].alias("hash"), node["item"].alias("item"), above.alias("steps")))
        kids = node["kids"]

        def one(child: Column, i: Column) -> Column:
            step = F.struct(joined(kids, F.lit(1), i).alias("before"), joined(kids, i + 2, F.size(kids)).alias("after"))
            # a level that was one node already has no hash of its own, so no step
            steps = F.filter(F.array(step), lambda s: F.col("n") > tree.fan ** (height - 1))
            return below(child, height - 1, F.concat(steps, above))

        return F.flatten(F.transform(kids, one))

    rows = blocks.select("seq", *keep, F.explode(below(F.col("node"), tree.digits, F.col("steps"))).alias("_e"))
    return rows.select("seq", *keep, "_e.*")


def unfolded(tables: list[DataFrame], above: DataFrame, tree: Tree, keep: list[str]) -> DataFrame:
    """Items of the lowest table with their steps; ``above`` has seq, ``keep`` and the steps over the root of each sequence."""
    found = emitted(tables[-1].join(above, "seq"), tree, keep)
    for table in reversed(tables[:-1]):
        over = settle(found.select("seq", F.col("item").alias("block"), "steps", *keep), "merkle-steps")
        found = emitted(table.join(over, ["seq", "block"]), tree, keep)
    return found


NO_STEPS = "cast(array() AS array<struct<before:string,after:string>>) AS steps"


def manifest(docs: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """doc_id, source, leaf, tampered, subroot, root, steps (array of the hashes before and after, leaf to root)."""
    scratch, kept = Scratch(), Scratch()
    held = scratch.settle(leaves(docs), "merkle-leaves")
    counted = scratch.settle(held.groupBy("source").agg(F.count("*").alias("n")), "merkle-counts")
    sources = scratch.settle(global_rank(counted, ["source"], "seq"), "merkle-sources")
    placed = running_totals(held, ["doc_id", "leaf"], {"at": F.lit(1).cast("bigint")}, ["source"], rows=held.count())
    named = placed.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    item = F.struct("doc_id", "source", "tampered").alias("item")
    trees = rounds(named.select("seq", (F.col("at") - 1).alias("at"), "n", F.col("leaf").alias("hash"), item), tree, kept)
    subroots = trees[-1].select(F.col("seq").alias("at"), F.col("node.hash").alias("hash"))
    many = sources.count()
    tops = rounds(subroots.selectExpr("0L AS seq", "at", f"{many}L AS n", "hash", "at AS item"), tree, scratch)
    top = tops[-1].selectExpr("seq", "node.hash AS root", NO_STEPS)
    over = unfolded(tops, top, tree, ["root"]).selectExpr("item AS seq", "hash AS subroot", "root", "steps")
    over = settle(over, "merkle-subroots")
    scratch.release()  # the proofs read the blocks and the steps above them only
    proofs = unfolded(trees, over, tree, ["subroot", "root"])
    return proofs.selectExpr("item.doc_id", "item.source", "hash AS leaf", "item.tampered", "subroot", "root", "steps")


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf's hash leads to."""
    return F.aggregate(steps, start, lambda h, s: hashed(s["before"], h, s["after"]))


def digest(proofs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (of the tampered leaf where there is one), verified."""
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    end = folded(F.coalesce("tampered", "leaf"), F.col("steps"))
    told = proofs.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), end.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = r"""
WITH RECURSIVE crc_table AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) r(i)),
drawn AS (SELECT d.*, xor(list_reduce([4294967295] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents d, crc_table),
fields AS (SELECT doc_id, source, h % 2 = 0 AS tamper, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head FROM drawn),
hashes AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN tamper THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS tampered FROM fields),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashes),
nodes AS (SELECT source, 0 AS level, place, count(*) OVER (PARTITION BY source) AS n, leaf AS hash FROM leaves
    UNION ALL SELECT source, level + 1, place // 3, any_value((n + 2) // 3), sha256(string_agg(hash, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY source, level, place // 3),
subroots AS (SELECT source, hash AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, place, count(*) OVER () AS n, subroot AS hash FROM subroots
    UNION ALL SELECT level + 1, place // 3, any_value((n + 2) // 3), sha256(string_agg(hash, '' ORDER BY place)) FROM tops WHERE n > 1 GROUP BY level, place // 3),
low AS (SELECT *, coalesce(string_agg(hash, '') OVER (PARTITION BY source, level, place // 3 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
    coalesce(string_agg(hash, '') OVER (PARTITION BY source, level, place // 3 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM nodes WHERE n > 1),
high AS (SELECT *, coalesce(string_agg(hash, '') OVER (PARTITION BY level, place // 3 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
    coalesce(string_agg(hash, '') OVER (PARTITION BY level, place // 3 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM tops WHERE n > 1),
over_leaves AS (SELECT l.source, l.place, list({'b': w.b, 'a': w.a} ORDER BY w.level) AS steps
    FROM leaves l JOIN low w ON l.source IS NOT DISTINCT FROM w.source AND w.place = l.place // (3 ** w.level)::BIGINT GROUP BY ALL),
over_sources AS (SELECT s.source, list({'b': w.b, 'a': w.a} ORDER BY w.level) AS steps FROM subroots s JOIN high w ON w.place = s.place // (3 ** w.level)::BIGINT GROUP BY ALL),
proofs AS (SELECT l.doc_id, l.leaf, l.tampered, s.subroot, (SELECT hash FROM tops WHERE n = 1) AS root, coalesce(ol.steps, []) || coalesce(os.steps, []) AS steps
    FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
    LEFT JOIN over_leaves ol ON l.source IS NOT DISTINCT FROM ol.source AND l.place = ol.place LEFT JOIN over_sources os ON l.source IS NOT DISTINCT FROM os.source),
ended AS (SELECT *, list_reduce([{'b': coalesce(tampered, leaf), 'a': ''}] || steps, lambda x, s: {'b': sha256(s.b || x.b || s.a), 'a': ''}).b AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(steps, lambda s: s.b || s.a), 'string_agg', ''), '')) AS proof_sha256,
    folded_root, folded_root = root AS verified FROM ended
"""
