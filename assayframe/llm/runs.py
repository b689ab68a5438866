"""Periodic runs of words: maximal stretches with a smallest period, from an enhanced suffix array.

The documents of a slice are laid end to end as word numbers, a number belonging to its document, so that nothing
matches across documents. Prefix doubling sorts the suffixes; the ranks of every round are kept, and comparing
them from the widest round down gives common prefixes (and common suffixes) of any two places. For each interval of common prefix length ``d``
in the suffix array, the suffixes ``i`` of all children but the largest are tested: if ``i + d`` or ``i - d`` lies in the same interval, by
its rank, and the words after the two copies differ, a branching square of period ``d`` ends there. Each suffix is thus
tested O(log n) times. A square is rotated to the left by whole rounds of equal ranks as far as the period holds; squares that end up at one
start and end are one run, whose period is the smallest of theirs.

Everything works on the arrays of a slice of documents, so a task needs no other rows. A run of ``least`` words repeats ``least / 2`` words, so
documents in which no such stretch occurs twice (by hash, which can err on the safe side only) are not sorted.

Defined cases: null and empty texts have no words and no runs; rows without doc_id are read like others, and not rewritten; repeated rows
give equal rows; runs of one start are ordered by period; a very long text is a slice of its own; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import per_row

#: Words that are sorted together, unless one document has more.
SLICE_WORDS = 300_000

#: Suffixes tested at a time.
TESTED = 2_000_000


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but space and the control characters 9 to 13, which is what bytes are split at."""
    return text.encode().split() if text else []


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For each place the place whose word it takes, for a tenth of the documents; None where nothing changes."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


class SuffixArray:
    """Suffixes of documents laid end to end (``codes``: word numbers, at least one; ``sizes``: words of each document)."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        n = len(codes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes)
        self.codes, self.n = codes, n
        self.end = ends[owner]
        self.start = (ends - sizes)[owner]
        # a rank is the place in order of the first of its group; one more entry, below all, stands for the end
        key = owner * (int(codes.max(initial=0)) + 1) + codes
        self.order = np.argsort(key, kind="stable")
        self.rank = np.full(n + 1, -1, np.int64)
        self.levels: list[np.ndarray] = []
        open_, key = np.arange(n), key[self.order]
        width = 1
        while True:
            heads = np.concatenate(([True], key[1:] != key[:-1]))
            group = np.cumsum(heads) - 1
            self.rank[self.order[open_]] = open_[heads][group]
            self.levels.append(self.rank.astype(np.int32))
            more = np.bincount(group)[group] > 1
            if not more.any():
                break
            open_ = open_[more]
            suffix = self.order[open_]
            second = np.where(suffix + width < self.end[suffix], self.rank[np.minimum(suffix + width, n)] + 1, 0)
            key = self.rank[suffix] * (n + 1) + second
            by = np.argsort(key, kind="stable")
            self.order[open_], key = suffix[by], key[by]
            width *= 2

    def common(self, a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
        """Words in which the suffixes at a and b agree; with ``sign`` -1, in which the texts before a and b do (a < b)."""
        a, b = a.copy(), b.copy()
        low = self.start[np.minimum(a, self.n - 1)]
        total = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            step, ranks = 1 << k, self.levels[k]
            if sign > 0:
                same = ranks[a] == ranks[b]
            else:
                same = (a - step >= low) & (ranks[np.maximum(a - step, 0)] == ranks[np.maximum(b - step, 0)])
            move = np.where(same, step, 0)
            total += move
            a += sign * move
            b += sign * move
        return total

    def prefixes(self) -> np.ndarray:
        """Common prefix of each suffix in order with the one before (0 for the first, and one more 0 at the end)."""
        out = np.zeros(self.n + 1, np.int64)
        first = self.levels[0][self.order]
        near = np.flatnonzero(first[1:] == first[:-1]) + 1
        out[near] = self.common(self.order[near - 1], self.order[near])
        return out


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place with a common prefix: the place, and the bounds of the widest stretch of suffixes that share as much."""
    at = np.flatnonzero(lcp)
    zero = np.flatnonzero(lcp == 0)
    widest = int(np.diff(zero).max(initial=1))
    least = [lcp]
    while 2 << (len(least) - 1) <= widest:
        half, step = least[-1], 1 << (len(least) - 1)
        wide = half.copy()
        wide[:-step] = np.minimum(half[:-step], half[step:])
        wide[-step:] = 0
        least.append(wide)
    deep, left, right = lcp[at], at.copy(), at + 1
    for k in range(len(least) - 1, -1, -1):
        step, low = 1 << k, least[k]
        left -= np.where((left >= step) & (low[np.maximum(left - step, 0)] >= deep), step, 0)
        right += np.where((right + step <= len(lcp)) & (low[np.minimum(right, len(lcp) - 1)] >= deep), step, 0)
    return at, left - 1, right


def branching_squares(s: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of the squares that the next word does not go on with."""
    lcp = s.prefixes()
    at, left, right = intervals(lcp)
    if not len(at):
        return at, at
    by = np.argsort(left * (s.n + 1) + right, kind="stable")
    at, left, right = at[by], left[by], right[by]
    head = np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
    group, first = np.cumsum(head) - 1, np.flatnonzero(head)
    # children: from the left bound to the first place of the interval, and from each place to the next one or the right bound
    stop = np.where(np.concatenate((head[1:], [True])), right, np.concatenate((at[1:], [0])))
    begin = np.concatenate((left[first], at))
    size = np.concatenate((at[first] - left[first], stop - at))
    of = np.concatenate((np.arange(len(first)), group))
    largest = np.zeros(len(first), np.int64)
    np.maximum.at(largest, of, size)
    full = np.flatnonzero(size == largest[of])
    skip = full[np.unique(of[full], return_index=True)[1]]
    small = np.ones(len(of), bool)
    small[skip] = False
    begin, size, of = begin[small], size[small], of[small]
    depth, low, high = lcp[at[first]], left[first], right[first]
    upto = np.cumsum(size)
    starts, periods = [], []
    done = 0
    while done < len(size):
        base = upto[done] - size[done]
        till = max(done + 1, int(np.searchsorted(upto, base + TESTED, "right")))
        sizes, g = size[done:till], np.repeat(of[done:till], size[done:till])
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        i = s.order[np.repeat(begin[done:till], sizes) + inside]
        d = depth[g]
        for here, there in ((i, i + d), (i - d, i)):
            other = there if here is i else here
            fits = (here >= s.start[i]) & (there < s.end[i])
            rank = s.rank[np.where(fits, other, s.n)]
            fits &= (rank >= low[g]) & (rank < high[g])
            a, b, e = there[fits], (there + d)[fits], s.end[i[fits]]
            ends = b >= e
            ends |= s.codes[np.minimum(a, s.n - 1)] != s.codes[np.minimum(b, s.n - 1)]
            starts.append(here[fits][ends])
            periods.append(d[fits][ends])
        done = till
    return np.concatenate(starts), np.concatenate(periods)


def maximal_runs(codes: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """start, end, period of the runs of at least ``least`` words, in order of start and period (places in ``codes``)."""
    if not len(codes):
        return np.zeros((0, 3), np.int64)
    s = SuffixArray(codes, sizes)
    start, period = branching_squares(s)
    end = start + 2 * period
    start = start - s.common(start, start + period, -1)
    long = end - start >= least
    found = np.unique(np.stack((start[long], end[long], period[long]), 1), axis=0)
    if len(found):
        one = np.concatenate(([True], (found[1:, :2] != found[:-1, :2]).any(axis=1)))
        found = found[one]  # the smallest period of each stretch comes first
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def may_run(hashes: np.ndarray, least: int) -> bool:
    """Does a stretch of words occur twice that a run of ``least`` words would repeat?"""
    n = max(1, least // 2)
    if len(hashes) <= n:
        return False
    wide, grams = hashes.view(np.uint64), np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + wide[k : len(wide) - n + 1 + k]
    grams.sort()
    return bool((grams[1:] == grams[:-1]).any())


Changed = Callable[[int | None, int], np.ndarray | None]


def _analysed(ids: list, texts: list, least: int, change: Changed | None) -> tuple[list, list, list]:
    n_words, collapsed, runs = [], [], []
    held: list[tuple[int, list[bytes]]] = []
    size = 0

    def settle() -> None:
        numbers: dict[bytes, int] = {}
        codes = np.array([numbers.setdefault(w, len(numbers)) for _, words in held for w in words], np.int64)
        sizes = np.array([len(words) for _, words in held], np.int64)
        found = maximal_runs(codes, sizes, least)
        ends = np.cumsum(sizes)
        cuts = np.searchsorted(found[:, 0], ends, "left")
        for (row, words), first, a, b in zip(held, ends - sizes, [0, *cuts[:-1]], cuts):
            if a == b:
                continue
            own = found[a:b] - [first, first, 0]
            runs[row] = [{"start": s, "length": e - s, "period": q} for s, e, q in own.tolist()]
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, own[:, 0] + own[:, 2], 1)
            np.add.at(edges, own[:, 1], -1)
            collapsed[row] = b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()])
        held.clear()

    for row, (doc_id, text) in enumerate(zip(ids, texts)):
        words = words_of(text)
        places = change(doc_id, len(words)) if change else None
        if places is not None:
            words = [words[i] for i in places.tolist()]
        n_words.append(len(words))
        collapsed.append(b" ".join(words))
        runs.append([])
        if may_run(np.fromiter(map(hash, words), np.int64, len(words)), least):
            if held and size + len(words) > SLICE_WORDS:
                settle()
                size = 0
            held.append((row, words))
            size += len(words)
    settle()
    return n_words, runs, collapsed


def find(docs: DataFrame, least: int = 12, change: Changed | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period: words from 0), collapsed (the words that no run
    contains beyond its first period, joined by a space). ``change`` gives the place that each word is taken from."""

    def make():
        return lambda ids, texts: _analysed(ids, texts, least, change)

    added = {"n_words": "long", "runs": "array<struct<start:long,length:long,period:long>>", "collapsed": "string"}
    return per_row(docs, ["doc_id"], ["doc_id", "text"], make, added)


def digest(found: DataFrame) -> DataFrame:
    """n_runs, the longest run (ties: smallest start, then period), hashes of all runs and of the words kept."""
    # the greatest by length, then by negated start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed").select(
        "doc_id",
        "n_runs",
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
