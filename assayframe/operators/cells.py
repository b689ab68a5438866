"""Points within a distance (L1) of each other, for a task that holds a tile of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Distances are compared at nine decimals.
DIGITS = 1e9
#: Block sums that sort the points of a tile, and the width of the cells that tell how crowded they are as a part of the reach.
BLOCKS, SIDE = 8, 0.5
_LEAF, _LEVELS = 4, 3  # points of a last range, at least; halvings between two looks at ranges
_STEPS = 124
_QUERIES = 2_048
_PAIRS = 1 << 18
_TOPS, _BYTES = np.uint64(0x8080808080808080), np.uint64(0x0101010101010101)
_EVEN, _ONES = np.uint64(0x00FF00FF00FF00FF), np.uint64(0x0001000100010001)


def reach_of(threshold: float) -> float:
    """What a lower bound of a distance may be at most, if the distance at nine decimals is within the threshold."""
    return threshold * (1 + 1e-9) + 1e-9


def spans_of(width: int, blocks: int) -> list[tuple[int, int]]:
    """(first, past the last) coordinate of each block."""
    blocks = max(1, min(blocks, width))
    cuts = [round(i * width / blocks) for i in range(blocks + 1)]
    return list(zip(cuts, cuts[1:]))


def matrix(coords: pa.ChunkedArray, width: int) -> np.ndarray:
    """One row a coordinate, one column a point; missing coordinates are NaN."""
    flat = coords.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(coords), width).T)


def _children(owner: np.ndarray, node: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (owner, place) with all places of the node; those of node i are first[i] to first[i + 1]."""
    n = first[node + 1] - first[node]
    shift = np.repeat(first[node] - (np.cumsum(n) - n), n)
    return np.repeat(owner, n), np.arange(len(shift)) + shift


def _starts(n: int, level: int) -> np.ndarray:
    """Where the 2 ** level ranges of n places begin and the last ends."""
    return np.arange((1 << level) + 1) * n >> level


def _halved(sums: np.ndarray, depth: int) -> np.ndarray:
    """An order in which each range of ``_starts`` is one half of a range of the level above, along its widest block."""
    order, far = np.arange(sums.shape[1]), np.abs(sums).max(initial=0.0) * 2 + 1
    for level in range(depth):
        first = _starts(len(order), level)
        here = sums[:, order]
        wide = (np.maximum.reduceat(here, first[:-1], axis=1) - np.minimum.reduceat(here, first[:-1], axis=1)).argmax(0)
        part = np.repeat(np.arange(len(wide)), np.diff(first))
        order = order[np.argsort(here[wide[part], np.arange(len(order))] + part * far)]
    return order


def _word(codes: np.ndarray) -> np.ndarray:
    """The codes of a point, one in a byte; bytes to spare are the same for all."""
    out = np.ones((codes.shape[1], 8), np.uint8)
    out[:, : len(codes)] = codes.T
    return out.view(np.uint64)[:, 0]


def _apart(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far the eight bytes of x are from the ranges low to high, added up; all bytes are below 128."""
    below = (low | _TOPS) - x
    mask = below & _TOPS
    mask -= mask >> np.uint64(7)
    below &= mask  # low - x where that is positive
    x |= _TOPS
    x -= high
    np.bitwise_and(x, _TOPS, out=mask)
    mask -= mask >> np.uint64(7)
    x &= mask
    x += below
    np.bitwise_and(x, _EVEN, out=mask)
    x >>= np.uint64(8)
    x &= _EVEN
    x += mask
    x *= _ONES
    x >>= np.uint64(48)
    return x


class Cells:
    """Points by their block sums, as a tree that halves them along the widest block. Sums count in steps of which a byte holds all
    there are, so that a word is a point or a corner of a range of points, and a few operations on words tell how far a
    point is from eight ranges. That is no more than its distance to any point there, so ranges beyond the reach are left."""

    def __init__(self, points: np.ndarray, threshold: float):
        self.threshold, self.reach = threshold, reach_of(threshold)
        self.spans = spans_of(len(points), BLOCKS)
        self.at = np.flatnonzero(np.isfinite(points).all(0))
        sums = self._sums(points)[:, self.at]
        n = sums.shape[1]
        self.base = sums.min(1, initial=np.inf)[:, None] if n else np.zeros((len(sums), 1))
        self.step = max(float((sums - self.base).max(initial=0.0)), self.reach) / _STEPS
        depth = (n // _LEAF).bit_length()
        order = _halved(sums, depth)
        self.at, self.sums = self.at[order], sums[:, order]
        self.points = points[:, self.at]
        codes = self._codes(self.sums)
        self.words = _word(codes)
        self.levels = []
        for k in sorted({*range(depth, 0, -_LEVELS), min(depth, _LEVELS)} if depth else {0}):
            first = _starts(n, k)
            low, high = ((f(codes, first[:-1], axis=1) for f in (np.minimum.reduceat, np.maximum.reduceat)) if n else (codes, codes))
            self.levels.append((k, _word(low - 1), _word(high + 1)))
        self.first = _starts(n, depth)

    def _sums(self, points: np.ndarray) -> np.ndarray:
        return np.stack([points[a:b].sum(0) for a, b in self.spans])

    def _codes(self, sums: np.ndarray) -> np.ndarray:
        """The step of each sum, from 1 to 126."""
        return (np.clip(np.floor((sums - self.base) / self.step), 0, _STEPS + 1) + 1).astype(np.uint8)

    def _candidates(self, sums: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs (query, place of a point) that the tree leaves; None if they are too many for one pass."""
        # points less than k + 1 steps apart may have k + 1 borders between them, of which _apart leaves out one
        words, limit = _word(self._codes(sums)), np.uint64(min(int(reach / self.step + 1e-6), 2_000))
        n, reached = sums.shape[1], 0
        owner, node = np.arange(n), np.zeros(n, np.int64)
        for k, low, high in self.levels:
            more = 1 << (k - reached)
            if n > 1 and len(owner) * more > _PAIRS:
                return None
            owner, node, reached = np.repeat(owner, more), (node[:, None] * more + np.arange(more)).ravel(), k
            near = np.flatnonzero(_apart(words[owner], low[node], high[node]) <= limit)
            owner, node = owner[near], node[near]
        if n > 1 and (self.first[node + 1] - self.first[node]).sum() > _PAIRS:
            return None
        owner, place = _children(owner, node, self.first)
        own = self.words[place]
        near = np.flatnonzero(_apart(words[owner], own - _BYTES, own + _BYTES) <= limit)
        return owner[near], place[near]

    def _passes(self, sums: np.ndarray, which: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        done, size = 0, _QUERIES
        while done < len(which) and len(self.at):
            some = which[done : done + size]
            found = self._candidates(sums[:, some], reach)
            if found is None:
                size = -(-len(some) // 2)
                continue
            done += len(some)
            size = min(_QUERIES, size + size // 8 + 1)
            if len(found[0]):
                yield some[found[0]], found[1]

    def _near(self, points: np.ndarray, sums: np.ndarray, query: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of candidate pairs those within the threshold, and their distances, added up as ``dedup.distance`` does."""
        for mine, theirs, step in ((sums, self.sums, 2), (points, self.points, len(points))):
            d = np.zeros(len(query))
            for i in range(len(mine)):
                d += np.abs(mine[i][query] - theirs[i][place])
                if i % step == step - 1 and i + 1 < len(mine):
                    left = d <= self.reach
                    d, query, place = d[left], query[left], place[left]
            left = d <= self.reach
            d, query, place = d[left], query[left], place[left]
        d = np.floor(d * DIGITS + 0.5) / DIGITS
        left = d <= self.threshold
        return query[left], place[left], d[left]

    def pairs(self, points: np.ndarray, later: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``points``, place in these points, distance) of all pairs within the threshold; with ``later`` = (ranks of
        ``points``, ranks of these), only pairs of a point and one of lower rank."""
        which = np.flatnonzero(np.isfinite(points).all(0))
        sums, parts = self._sums(points), []
        # neighbours look at the same ranges, one after the other
        which = which[_halved(sums[:, which], (len(which) // _LEAF).bit_length())]
        for query, place in self._passes(sums, which, self.reach):
            if later is not None:
                ahead = later[1][self.at[place]] < later[0][query]
                query, place = query[ahead], place[ahead]
            parts.append(self._near(points, sums, query, place))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query, place, d = (np.concatenate(x) for x in zip(*parts))
        return query, self.at[place], d

    def touched(self, points: np.ndarray) -> np.ndarray:
        """Is a point within the threshold of one of these? Closest branches come first: one near point is enough."""
        out = np.zeros(points.shape[1], bool)
        sums, fit = self._sums(points), np.isfinite(points).all(0)
        for reach in (0.0, self.reach / 4, self.reach):
            for query, place in self._passes(sums, np.flatnonzero(fit & ~out), reach):
                out[self._near(points, sums, query, place)[0]] = True
        return out
