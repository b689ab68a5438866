"""Points within a distance of each other, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dedup import SCALE, brute, keep, make

from assayframe.operators import cells
from assayframe.operators import dedup as X


def shares(n, width=24, parts=4, seed=0):
    """Cumulative shares of a few parts, one column a point."""
    rnd = np.random.default_rng(seed)
    amounts = np.zeros((n, width + 1))
    for row in amounts:
        row[rnd.integers(0, width + 1, parts)] += rnd.integers(1, 50, parts)
    return (amounts.cumsum(1) / amounts.sum(1, keepdims=True)).T[:width]


def all_pairs(mine, theirs, t):
    d = np.zeros((mine.shape[1], theirs.shape[1]))
    for a, b in zip(mine, theirs):
        d += np.abs(a[:, None] - b)
    return {(i, j): d[i, j] for i, j in zip(*np.nonzero(np.floor(d * 1e9 + 0.5) / 1e9 <= t))}


@pytest.mark.parametrize("width,t", [(24, 0.5), (24, 3.0), (24, 0.0), (5, 0.3), (1, 0.1)])
def test_pairs_are_those_of_a_scan(monkeypatch, width, t):
    monkeypatch.setattr(cells, "_PAIRS", 300)  # few at a time
    mine, theirs = shares(150, width, 3, 1), shares(200, width, 3, 2)
    theirs[:, :20] = mine[:, :20]
    mine[0, 3] = theirs[0, 8] = np.nan
    tree = cells.Cells(theirs, t)
    query, at, d = tree.pairs(mine)
    want = all_pairs(mine, theirs, t)
    got = dict(zip(zip(query.tolist(), at.tolist()), d.tolist()))
    assert got.keys() == want.keys() and len(query) == len(want) and np.allclose([got[k] for k in want], list(want.values()), atol=1e-9)
    assert set(np.flatnonzero(tree.touched(mine))) == {i for i, _ in want}
    later = (np.arange(150), np.arange(200))
    assert set(zip(*(x.tolist() for x in tree.pairs(mine, later)[:2]))) == {(i, j) for i, j in want if j < i}


def test_nothing_to_search():
    some, none = shares(5), np.zeros((24, 0))
    assert not cells.Cells(none, 0.5).touched(some).any() and len(cells.Cells(some, 0.5).pairs(none)[0]) == 0


def test_few_candidates_beside_those_of_three_block_sums(monkeypatch):
    """A grid of three block sums left hundreds of candidates for each near point, which grew with the square of the input."""
    points = shares(4_000)
    looked, near = [0], cells.Cells._near
    monkeypatch.setattr(cells.Cells, "_near", lambda self, p, s, q, place: (looked.__setitem__(0, looked[0] + len(q)), near(self, p, s, q, place))[1])
    cells.Cells(points, 0.5).pairs(points)
    idx = np.floor(np.stack([points[a:b].sum(0) for a, b in cells.spans_of(24, 3)]) / 0.5)
    beside = sum(int((np.abs(idx - idx[:, [i]]) <= 1).all(0).sum()) for i in range(points.shape[1]))
    assert looked[0] * 4 < beside


def test_points_go_to_tiles_within_reach_only(spark):
    grid = X._Grid(3, 1.0, 3)  # tiles two wide
    df = spark.createDataFrame([([1.2, 0.9, 0.8],), ([0.2, 0.3, 1.2],)], "c array<double>")
    got = [r[0] for r in df.select(F.size(grid.around(F.lit("all"), grid.sums(F.col("c"))))).collect()]
    assert got == [4, 5]  # own, and past one border each (not two); own, two borders, both of them, the third


def test_many_prefixes(spark, monkeypatch):
    rounds, untouched = [], X._untouched
    monkeypatch.setattr(X, "_untouched", lambda *a: (rounds.append(1), untouched(*a))[1])
    rows = make(200, hot=0.2, seed=13)
    assert keep(spark, rows, 0.6, pair_budget=300) == brute(rows, SCALE, 0.6)
    assert rounds


def test_hardly_more_candidates_than_the_block_sums_leave(monkeypatch):
    """Ranges of a quarter in each of eight sums left thousands of candidates for each point within the threshold."""
    points = shares(4_000, parts=6)
    looked, near = [0], cells.Cells._near
    monkeypatch.setattr(cells.Cells, "_near", lambda self, p, s, q, place: (looked.__setitem__(0, looked[0] + len(q)), near(self, p, s, q, place))[1])
    cells.Cells(points, 0.5).pairs(points)
    sums = np.stack([points[a:b].sum(0) for a, b in cells.spans_of(24, 8)])
    left = sum(int((np.abs(sums - sums[:, [i]]).sum(0) <= 0.5).sum()) for i in range(points.shape[1]))
    assert left <= looked[0] < 4 * left


def test_bytes_apart():
    rnd = np.random.default_rng(3)
    x, low, size = rnd.integers(1, 127, (8, 500)), rnd.integers(0, 127, (8, 500)), rnd.integers(0, 127, (8, 500))
    high = np.minimum(low + size, 127)
    x[:, :20], low[:, :20], high[:, :20] = 126, 0, 0  # as far as bytes can be
    got = cells._apart(*(cells._word(c.astype(np.uint8)) for c in (x, low, high)))
    assert got.tolist() == np.maximum(np.maximum(low - x, x - high), 0).sum(0).tolist()


@pytest.mark.parametrize("n", [1, 3, 4, 9, 33, 257])
def test_few_points_and_copies(n):
    mine, theirs = shares(40, seed=5), shares(n, seed=6)
    theirs[:, n // 2 :] = theirs[:, [0]]
    mine[:, 7] = theirs[:, 0]
    tree = cells.Cells(theirs, 0.4)
    query, at, _ = tree.pairs(mine)
    want = set(all_pairs(mine, theirs, 0.4))
    assert set(zip(query.tolist(), at.tolist())) == want and len(query) == len(want)
    assert set(np.flatnonzero(tree.touched(mine))) == {i for i, _ in want}


def test_coordinates_by_hand(spark, monkeypatch):
    monkeypatch.setattr(X, "_CELLS", 30)  # few rows at a time
    rows = [(1, "a", 0.1), (1, "c", 0.2), (1, "b", 0.3), (2, "d", 4.0), (3, "a", 1.0), (3, "x", 1.0), (4, "b", None), (4, "a", 1.0), (4, "d", 2.0), (5, "c", 0.0), (None, "b", 2.0), (None, "b", 1.0)]
    comp = spark.createDataFrame(rows, "row_id long, element string, amount double")
    out = X.coordinates(comp, X.Scale({"a": 0.0, "b": 1.0, "c": 3.0, "d": 3.5}))
    assert "lambda" not in out._jdf.queryExecution().toString()  # nothing is interpreted for each row and step
    got = {r["row_id"]: (r["num_atoms"], r["coords"]) for r in out.collect()}
    total = (0.1 + 0.3) + 0.2
    assert got.keys() == {1, 2, 4, None}
    assert got[1][1] == [0.1 / got[1][0] * 1.0, (0.1 + 0.3) / got[1][0] * 2.0, total / got[1][0] * 0.5]
    assert got[2] == (4.0, [0.0, 0.0, 0.0]) and got[None] == (3.0, [0.0, 2.0, 0.5])
    assert got[4] == (3.0, [1 / 3, None, None])
