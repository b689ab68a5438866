"""Greedy removal against the sequential scan it must equal."""

import random
from collections import defaultdict

import pytest

from assayframe.operators import arms as R
from assayframe.operators import dedup as X


def brute(rows, scale, t, seed=None, drop_first=False):
    bags = defaultdict(dict)
    for r, e, a in rows:
        bags[r][e] = a
    at = {r: scale.coordinates(b) for r, b in bags.items() if all(e in scale.positions for e in b)}
    order = sorted(at, key=lambda r: (sum(bags[r].values()), r))
    if drop_first:
        order = order[1:]
    dist = lambda x, y: round(sum(abs(a - b) for a, b in zip(x, y)), 9)
    kept, pts = [], []
    if seed is not None:
        pts.append(scale.coordinates(seed[1]))
        if seed[0] in order:
            kept.append(seed[0])
            order.remove(seed[0])
    for r in order:
        if all(dist(at[r], p) > t for p in pts):
            kept.append(r)
            pts.append(at[r])
    return sorted(kept)


def make(n, vocab=12, seed=1, hot=0.0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if rnd.random() < hot:
            rows += [(i, "e3", 2.0), (i, "e4", float(rnd.choice((2, 3))))]
        else:
            rows += [(i, f"e{e}", float(rnd.randint(1, 5))) for e in rnd.sample(range(1, vocab + 1), rnd.randint(1, 4))]
    return rows


SCALE = X.Scale({f"e{i}": float(i) for i in range(1, 13)})


def comp_of(spark, rows):
    return spark.createDataFrame(rows, "row_id int, element string, amount double")


def keep(spark, rows, t, scale=SCALE, **kw):
    return sorted(r[0] for r in X.greedy_keep(comp_of(spark, rows), scale, t, **kw).collect())


@pytest.mark.parametrize("t,budget,few", [(0.0, None, 100_000), (0.3, None, 0), (1.0, 3000, 0), (1.0, None, 10), (3.0, 3000, 100_000)])
def test_equals_sequential_scan(spark, t, budget, few):
    rows = make(220, hot=0.35)
    assert keep(spark, rows, t, pair_budget=budget, few_edges=few) == brute(rows, SCALE, t)


def test_shuffled_and_salted_path(spark, monkeypatch):
    monkeypatch.setattr(X, "_SMALL_BYTES", 0)
    monkeypatch.setattr(X, "_HOT_MIN", 5)
    rows = make(200, hot=0.4, seed=3)
    assert keep(spark, rows, 0.8, pair_budget=20_000) == brute(rows, SCALE, 0.8)


def test_points_on_a_line(spark):
    scale = X.Scale({"a": 0.0, "b": 4.0})
    line = lambda pts: [r for i, x in enumerate(pts) for r in ((i, "a", 4.0 - x), (i, "b", float(x))) if r[2] > 0]
    assert keep(spark, line([0, 1, 2, 3]), 1.0, scale) == [0, 2]
    assert keep(spark, line([0, 1, 0, 3]), 0.0, scale) == [0, 1, 3]


def test_wide_scale_uses_the_same_distance(spark):
    scale = X.Scale({f"e{i}": float(i * i) for i in range(1, 81)})
    rows = make(60, vocab=80, seed=5)
    assert keep(spark, rows, 300.0, scale) == brute(rows, scale, 300.0)


def test_seed_drop_first_and_unknown_elements(spark):
    rows = make(80, seed=7) + [(999, "zz", 1.0)]
    bag = {"e5": 1.0, "e6": 1.0}
    assert keep(spark, rows, 0.9, seed=(-1, bag)) == brute(rows, SCALE, 0.9, (-1, bag))
    inside = {e: a for r, e, a in rows if r == 10}
    assert keep(spark, rows, 0.9, seed=(10, inside)) == brute(rows, SCALE, 0.9, (10, inside))
    assert keep(spark, rows, 0.9, drop_first=True) == brute(rows, SCALE, 0.9, drop_first=True)


def test_groups_are_independent(spark):
    rows = make(120, seed=9)
    members = [("g0", i) for i in range(120)] + [("g1", i) for i in range(0, 120, 2)] + [("g2", i) for i in range(30)]
    m = spark.createDataFrame(members, "grp string, row_id int")
    got = defaultdict(list)
    for r in X.greedy_keep(comp_of(spark, rows), SCALE, 0.7, members=m).collect():
        got[r["grp"]].append(r["row_id"])
    for g in ("g0", "g1", "g2"):
        inside = {i for n, i in members if n == g}
        assert sorted(got[g]) == brute([r for r in rows if r[0] in inside], SCALE, 0.7)


def test_distances(spark):
    scale = X.Scale({"1": 1.0, "2": 2.0, "3": 3.0})
    comp = comp_of(spark, [(1, "1", 1.0), (2, "3", 1.0), (3, "1", 2.0), (3, "3", 2.0), (4, "2", 7.0)])
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    assert {(r["a"], r["b"]): r["distance"] for r in X.pair_distances(pairs, comp, scale).collect()} == {(1, 2): 2.0, (3, 4): 1.0}


def test_one_per_key(spark):
    df = spark.createDataFrame([(1, "x", 0.1), (2, "x", None), (3, "x", 0.0), (5, "y", None), (4, "y", None), (6, None, 1.0)], "id int, k string, hull double")
    assert sorted(r["id"] for r in X.one_per_key(df, "k", "hull", "id").collect()) == [3, 4]
    assert sorted(r["id"] for r in X.one_per_key(df, "k", None, "id").collect()) == [1, 4]


def test_arms(spark):
    rows = make(90, seed=11)
    train = spark.createDataFrame([("s", f, i, i) for f, ids in (("a", range(90)), ("b", range(45))) for i in ids], "split string, fold string, row_id int, item int")
    subs = R.train_subsets(train, comp_of(spark, rows), SCALE, 0.7).cache()
    for f, ids in (("a", set(range(90))), ("b", set(range(45)))):
        arm = lambda a: {r["row_id"] for r in subs.where(f"fold = '{f}' and arm = '{a}'").collect()}
        want = set(brute([r for r in rows if r[0] in ids], SCALE, 0.7))
        assert arm("dedup") == want and len(arm("sizematched")) == len(want) and arm("sizematched") <= ids
    sizes = {r["fold"]: (r["n_train"], r["n_dedup"]) for r in R.arm_sizes(train, subs).collect()}
    assert sizes["a"][0] == 90 and sizes["b"][0] == 45
