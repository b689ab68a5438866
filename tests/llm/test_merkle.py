"""The Merkle manifest against a plain rewrite with hashlib."""

import hashlib
import zlib

import pytest

from assayframe.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climbed(hashes):
    """Levels of a tree, bottom first."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, at):
    for level in levels[:-1]:
        start = at // 3 * 3
        yield level[start:at], level[at + 1 : start + 3]
        at //= 3


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = climbed([leaf(r) for r in groups[s]])
    top = climbed([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            steps = [*path(trees[s], i), *path(top, k)]
            other = r
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                other = (*r[:4], r[4].replace("\n", ""))
            end = leaf(other)
            for b, a in steps:
                end = digest(*b, end, *a)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[s][-1][0], root, digest(*[h for b, a in steps for h in (*b, *a)]), end, end == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def cases():
    rows = [(i, f"s{i % 4}" if i % 7 else "hot", "en", i, f"line {i}\nand more\n" if i % 3 else f"one line {i}") for i in range(120)]
    rows += [(1000 + i, "hot", None, None, "x\ny") for i in range(60)]
    rows += [(None, None, None, None, None), (None, "hot", "en", 1, "a\nb"), (None, "hot", "en", 1, "a\nb"), (5, None, "de", 2, "")]
    rows += [(7, "hot", "en", 3, "same\n")] * 4 + [(8, "é", "fr", 3, "été\n"), (9, "z" * 50, "fr", 3, "long " * 60_000 + "\n"), (-3, "lone", "fr", 1, "\n")]
    return rows


@pytest.mark.parametrize("tree", [merkle.Tree(digits=1), merkle.Tree(digits=2), merkle.Tree()])
def test_manifest_equals_plain_rewrite(spark, tree):
    rows = cases()
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS leaf", "1 AS at", "2 AS n", "'y' AS seq", "'z' AS hash").repartition(5)
    got = sorted([tuple(r[c] for c in COLUMNS) for r in merkle.digest(merkle.manifest(docs, tree)).collect()], key=str)
    assert got == plain(rows)


@pytest.mark.parametrize("rows", [[(1, "a", "en", 1, "t\n")], [(1, "a", "en", 1, "t\n"), (2, "b", "en", 1, "u\n")], [(i, "a", "en", 1, "t\n") for i in range(4)], [(i, None, None, 1, None) for i in range(9)]])
def test_small_trees(spark, rows):
    got = sorted([tuple(r[c] for c in COLUMNS) for r in merkle.digest(merkle.manifest(spark.createDataFrame(rows, SCHEMA))).collect()], key=str)
    assert got == plain(rows)


def test_empty_table(spark):
    assert merkle.digest(merkle.manifest(spark.createDataFrame([], SCHEMA))).collect() == []


def test_one_shuffle_for_all_groupings_of_a_block(spark):
    items = spark.range(2000).selectExpr("id % 3 AS seq", "id AS at", "id % 3 + 2000 AS n", "sha2(cast(id AS string), 256) AS hash", "id AS item")
    plan = merkle.rolled(items, merkle.Tree())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
