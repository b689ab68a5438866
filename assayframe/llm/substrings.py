"""Removal of byte strings of a given length that start anywhere else, by sorted suffixes.

Sorting a suffix for every byte would write eight bytes or more a byte. Suffixes are therefore sorted at
anchors only, which is exact: every window of ``length`` bytes is assigned the leftmost of its grams (``gram``
bytes) with the least hash, so equal windows have equal anchors at equal offsets, and one anchor serves the
windows of many bytes (about one anchor in 70 bytes). Two filters, both exact, come before the sort:

1. an anchor whose gram occurs once cannot share a window;
2. an anchor all of whose windows (one stretch of bytes) occur a second time is settled: all of them go. Copies
   of documents end here; a task settles its own copies first and sends one of them on.

The rest, anchors near the edges of repeated passages, are sorted by what follows the anchor. Each task sorts
its suffixes into runs and sends them front-coded (common prefix with the one before, and the
rest) to the bucket of the gram; the bucket combines its runs with a loser tree that carries common-prefix
lengths and never compares a prefix again. The merge leaves the common prefixes of neighbours: at
offset ``o`` the suffixes fall into classes that share ``length - o`` bytes, and with a rolling hash of the ``o`` bytes
before the anchor, the windows found twice are the pairs (class, hash) found twice.

Defined cases: null is an empty text; texts shorter than ``length`` lose nothing; repeated rows are copies
and lose all windows; matches never cross documents; an empty table gives an empty result; other columns are ignored.
A gram of a large share of all documents in different surroundings meets in one bucket, as front-coded suffixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import per_row
from assayframe.llm.neardup import mix, salts
from assayframe.sources.session import release, settle


@dataclass(frozen=True)
class Repeats:
    """Parameters in bytes (``length - gram`` at most 255), and records that a task holds before it sends them."""

    length: int = 200
    gram: int = 64
    held: int = 2_000_000


RECORD = np.dtype([("gram", "<u8"), ("stretch", "<u8"), ("row", "<i8"), ("first", "<u4"), ("more", "u1"), ("left", "u1"), ("settled", "u1")])
RANGE = np.dtype([("start", "<u4"), ("end", "<u4")])
WANT = np.dtype([("first", "<u4"), ("more", "u1"), ("left", "u1"), ("asked", "u1")])
_BYTE = salts(256)
_BASE = int(salts(999)[-1]) | 1


def grams(data: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes of all grams, by doubling."""
    h, have, out, done = _BYTE[data], 1, None, 0
    while True:
        if length & have:
            n = len(data) - done - have + 1
            out = h[:n] if out is None else out[: n] * np.uint64(pow(_BASE, have, 1 << 64)) + h[done : done + n]
            done += have
        if done == length:
            return mix(out)
        h = h[:-have] * np.uint64(pow(_BASE, have, 1 << 64)) + h[have:]
        have *= 2


def anchors(data: np.ndarray, p: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, first and last window of each anchor, hash of its gram."""
    n = len(data) - p.length + 1
    h = grams(data, p.gram)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    wide, have = p.length - p.gram + 1, 1
    while 2 * have <= wide:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    low = np.minimum(low[:n], low[wide - have : wide - have + n])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(first[1:], n) - 1
    return at[first], first, last, h[at[first]]


def document_records(row: int, text: str | None, p: Repeats) -> np.ndarray | None:
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    if len(raw) < p.length:
        return None
    at, first, last, gram = anchors(np.frombuffer(raw, np.uint8), p)
    out = np.zeros(len(at), RECORD)
    digest, length = xxhash.xxh3_64_intdigest, p.length
    out["stretch"] = np.fromiter((digest(raw[a : b + length]) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(at))
    # the place of the anchor in its stretch is part of what has to agree
    out["stretch"] ^= mix((at - first).astype(np.uint64) + np.uint64(1))
    out["gram"], out["row"], out["first"], out["more"], out["left"] = gram, row, first, last - first, at - first
    return out


def _by_row(rows: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The values of each row, as bytes."""
    order = np.argsort(rows, kind="stable")
    rows, values = rows[order], values[order]
    cuts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else []
    for s, e in zip(cuts, [*cuts[1:], len(rows)]):
        yield int(rows[s]), values[s:e].tobytes()


def ranges_of(records: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(records), RANGE)
    out["start"] = records["first"]
    out["end"] = records["first"] + records["more"].astype(np.uint32) + np.uint32(length)
    return out


PACKED = "bucket int, kind int, row long, data binary"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "kind", "row", "data"])


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Number of the group of equal keys, for sorted keys."""
    change = np.zeros(len(keys[0]), bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.cumsum(change)


def _send(records: np.ndarray, p: Repeats, n_buckets: int) -> pd.DataFrame:
    """Settle what repeats within the task, send one record of it, and all others."""
    records = records[np.lexsort((records["stretch"], records["gram"]))]
    group = _groups(records["gram"], records["stretch"])
    twice = np.bincount(group)[group] > 1
    head = np.concatenate(([True], group[1:] != group[:-1]))
    local = records[twice]
    bucket_of = lambda rows: (mix(rows.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
    rows = [(int(bucket_of(np.array([r], np.int64))[0]), 0, r, d) for r, d in _by_row(local["row"], ranges_of(local, p.length))]
    records["settled"] = twice
    sent = records[head | ~twice]
    buckets = (sent["gram"] % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(buckets, kind="stable")
    buckets, sent = buckets[order], sent[order]
    cuts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
    rows += [(int(buckets[s]), 1, 0, sent[s:e].tobytes()) for s, e in zip(cuts, [*cuts[1:], len(sent)])]
    return _frame(rows)


def records(rows: DataFrame, p: Repeats, n_buckets: int) -> DataFrame:
    """Kind 0: ranges settled in the task; kind 1: records of a bucket."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            for row, text in zip(frame["row"], frame["text"]):
                found = document_records(row, text, p)
                if found is not None:
                    held.append(found)
                    n += len(found)
                    if n >= p.held:
                        yield _send(np.concatenate(held), p, n_buckets)
                        held, n = [], 0
        if held:
            yield _send(np.concatenate(held), p, n_buckets)

    return rows.select("row", "text").mapInPandas(run, PACKED)


def settled_or_open(packed: DataFrame, p: Repeats, n_buckets: int) -> DataFrame:
    """Of each bucket: ranges (kind 0) and the anchors whose surroundings are needed (kind 2, by row)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}
        for frame in frames:
            done = frame["kind"] == 0
            if done.any():
                yield frame[done]
            for bucket, data in zip(frame.loc[~done, "bucket"], frame.loc[~done, "data"]):
                held.setdefault(bucket, []).append(np.frombuffer(data, RECORD))
        for bucket in list(held):
            every = np.concatenate(held.pop(bucket))
            every = every[np.lexsort((every["stretch"], every["gram"]))]
            gram, stretch = _groups(every["gram"]), _groups(every["gram"], every["stretch"])
            head = np.concatenate(([True], stretch[1:] != stretch[:-1]))
            settled = (np.bincount(stretch) > 1) | (np.bincount(stretch, every["settled"]) > 0)
            settled = settled[stretch]
            now = every[settled & (every["settled"] == 0)]
            rows = [(bucket, 0, r, d) for r, d in _by_row(now["row"], ranges_of(now, p.length))]
            kinds = np.bincount(gram, head)  # different surroundings of a gram
            single = np.bincount(gram, ~settled)
            needed = head & ((kinds > 1) & (single > 0))[gram]
            wanted = every[needed]
            out = np.empty(len(wanted), WANT)
            out["first"], out["more"], out["left"], out["asked"] = wanted["first"], wanted["more"], wanted["left"], ~settled[needed]
            rows += [(bucket, 2, r, d) for r, d in _by_row(wanted["row"], out)]
            if rows:
                yield _frame(rows)

    return packed.repartitionById(n_buckets, F.col("bucket")).mapInPandas(run, PACKED)


# --- suffixes ---------------------------------------------------------------------------------


def common(a: bytes, b: bytes, h: int) -> int:
    """Length of the common prefix, of which ``h`` bytes are known."""
    n = min(len(a), len(b))
    while h < n:
        e = min(n, h + 32)
        x, y = a[h:e], b[h:e]
        if x != y:
            d = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return e - 1 - (d.bit_length() - 1) // 8
        h = e
    return n


#: Of an item in a run: common prefix with the one before, length of the rest, left context, windows beyond the first, asked for; row and first window.
ITEM = np.dtype([("prefix", "u2"), ("rest", "u2"), ("left", "u1"), ("more", "u1"), ("asked", "u1"), ("row", "<i8"), ("first", "<u4")])


def run_of(items: list[tuple[bytes, bytes, int, int, int, int]]) -> bytes:
    """Front-coded run of (suffix, left context, windows beyond the first, asked, row, first), sorted by suffix."""
    items = sorted(items, key=lambda x: x[0])
    head, parts, last = np.zeros(len(items), ITEM), [], b""
    for i, (suffix, left, more, asked, row, first) in enumerate(items):
        h = common(last, suffix, 0)
        head[i] = (h, len(suffix) - h, len(left), more, asked, row, first)
        parts += [suffix[h:], left]
        last = suffix
    return len(items).to_bytes(4, "little") + head.tobytes() + b"".join(parts)


class Run:
    """Reads a run: the current suffix, and its common prefix with the last suffix that the merge gave out."""

    def __init__(self, data: bytes):
        n = int.from_bytes(data[:4], "little")
        self.heads = np.frombuffer(data, ITEM, n, 4).tolist()
        self.data, self.at, self.i = data, 4 + n * ITEM.itemsize, -1
        self.suffix = b""
        self.step()

    def step(self) -> None:
        self.i += 1
        if self.i == len(self.heads):
            self.suffix = None
            return
        self.prefix, rest, left = self.heads[self.i][:3]
        self.suffix = self.suffix[: self.prefix] + self.data[self.at : self.at + rest]
        self.at += rest
        self.left = self.data[self.at : self.at + left]
        self.at += left


def merged(runs: list[Run]) -> Iterator[tuple[int, bytes, bytes, tuple]]:
    """(common prefix with the one before, suffix, left context, head) of all runs in order, by a loser tree.

    All prefix lengths are with the last suffix given out. The longer one of two is the smaller suffix and nothing is
    compared; bytes are looked at only behind equal prefixes, and the loser keeps what that showed."""
    k = 1
    while k < len(runs):
        k *= 2
    runs = runs + [None] * (k - len(runs))

    def play(a: Run | None, b: Run | None) -> tuple[Run | None, Run | None]:
        """Winner and loser."""
        if b is None or b.suffix is None:
            return a, b
        if a is None or a.suffix is None:
            return b, a
        if a.prefix != b.prefix:
            return (a, b) if a.prefix > b.prefix else (b, a)
        x, y = a.suffix, b.suffix
        h = common(x, y, a.prefix)
        if h == len(x) or (h < len(y) and x[h] < y[h]):
            b.prefix = h
            return a, b
        a.prefix = h
        return b, a

    for r in runs:
        if r is not None and r.suffix is not None:
            r.prefix = 0
    losers: list = [None] * k
    place: dict[int, int] = {}
    level = []
    for i, r in enumerate(runs):
        level.append(r)
        if r is not None:
            place[id(r)] = i
    node = k
    while len(level) > 1:
        node //= 2
        following = []
        for j in range(0, len(level), 2):
            winner, losers[node + j // 2] = play(level[j], level[j + 1])
            following.append(winner)
        level = following
    top = level[0]
    while top is not None and top.suffix is not None:
        yield top.prefix, top.suffix, top.left, top.heads[top.i]
        slot = (place[id(top)] + k) // 2
        top.step()
        while slot:
            top, losers[slot] = play(top, losers[slot])
            slot //= 2


def repeated_windows(runs: list[bytes], p: Repeats) -> list[tuple[int, bytes]]:
    """Ranges (by row) of the windows that occur twice among the suffixes of a bucket."""
    prefix, left, heads = [], [], []
    for h, _, l, head in merged([Run(r) for r in runs]):
        prefix.append(h)
        left.append(l[::-1])
        heads.append(head)
    n = len(heads)
    prefix = np.array(prefix, np.int64)
    size, more, asked = (np.array([h[c] for h in heads], np.int64) for c in (2, 4 - 1, 4))
    row, first = np.array([h[5] for h in heads], np.int64), np.array([h[6] for h in heads], np.int64)
    wide = p.length - p.gram
    before = np.zeros((n, wide + 1), np.uint8)
    for i, l in enumerate(left):
        before[i, : len(l)] = np.frombuffer(l, np.uint8)
    hashed = np.full(n, np.uint64(1))
    hits_row, hits_at = [], []
    for o in range(wide + 1):
        if o:
            hashed = mix(hashed * np.uint64(_BASE) + _BYTE[before[:, o - 1]])
        there = np.flatnonzero((o <= size) & (o >= size - more))
        if len(there) < 2:
            continue
        klass = np.cumsum(prefix < p.length - o)
        key = mix(hashed[there] + mix(klass[there].astype(np.uint64)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        found = np.zeros(len(there), bool)
        found[order[1:][same]] = True
        found[order[:-1][same]] = True
        there = there[found]
        there = there[asked[there] == 1]
        hits_row.append(row[there])
        hits_at.append(first[there] + size[there] - o)
    if not hits_row:
        return []
    out = np.empty(sum(map(len, hits_at)), RANGE)
    out["start"] = np.concatenate(hits_at)
    out["end"] = out["start"] + np.uint32(p.length)
    return [(r, union(np.frombuffer(d, RANGE)).tobytes()) for r, d in _by_row(np.concatenate(hits_row), out)]


def union(ranges: np.ndarray) -> np.ndarray:
    """Sorted disjoint ranges; ranges that touch become one."""
    if not len(ranges):
        return ranges
    ranges = ranges[np.argsort(ranges["start"], kind="stable")]
    reach = np.maximum.accumulate(ranges["end"])
    head = np.concatenate(([True], ranges["start"][1:] > reach[:-1]))
    starts = np.flatnonzero(head)
    out = np.empty(len(starts), RANGE)
    out["start"], out["end"] = ranges["start"][starts], reach[np.append(starts[1:], len(ranges)) - 1]
    return out


def runs(wanted: DataFrame, p: Repeats, n_buckets: int) -> DataFrame:
    """Sorted front-coded runs (bucket, data) of the surroundings wanted; ``wanted`` has text, buckets and wants."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        n = 0
        for frame in frames:
            for row, text, parts in zip(frame["row"], frame["text"], frame["parts"]):
                raw = text.encode("utf-8", "surrogatepass")
                for part in parts:
                    mine = held.setdefault(part["bucket"], [])
                    for first, more, left, asked in np.frombuffer(part["data"], WANT).tolist():
                        at = first + left
                        mine.append((raw[at : first + more + p.length], raw[first:at], more, asked, row, first))
                        n += 1
            if n >= p.held // 20:
                yield pd.DataFrame([(b, run_of(i)) for b, i in held.items()], columns=["bucket", "data"])
                held, n = {}, 0
        if held:
            yield pd.DataFrame([(b, run_of(i)) for b, i in held.items()], columns=["bucket", "data"])

    return wanted.select("row", "text", "parts").mapInPandas(run, "bucket int, data binary")


def combined(sorted_runs: DataFrame, p: Repeats, n_buckets: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[bytes]] = {}
        for frame in frames:
            for bucket, data in zip(frame["bucket"], frame["data"]):
                held.setdefault(bucket, []).append(data)
        for bucket in list(held):
            found = repeated_windows(held.pop(bucket), p)
            if found:
                yield pd.DataFrame(found, columns=["row", "data"])

    return sorted_runs.repartitionById(n_buckets, F.col("bucket")).mapInPandas(run, "row long, data binary")


def removed(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """doc_id, text and the removed ranges of its UTF-8 bytes (``spans``: start, end as little-endian uint32; null if none)."""
    spark = docs.sparkSession
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    first = settle(settled_or_open(records(rows, p, n_buckets), p, n_buckets), "repeat-anchors")
    wants = first.where("kind = 2").groupBy("row").agg(F.collect_list(F.struct("bucket", "data")).alias("parts"))
    late = settle(combined(runs(rows.select("row", "text").join(wants, "row"), p, n_buckets), p, n_buckets), "repeat-edges")
    spans = first.where("kind = 0").select("row", "data").union(late).groupBy("row").agg(F.collect_list("data").alias("found"))
    spans = settle(spans, "repeat-spans")
    release(first, late)
    return rows.join(spans, "row", "left").select("doc_id", "text", "found")


def remaining(raw: bytes, found) -> tuple[np.ndarray, bytes]:
    """Disjoint removed ranges, and the bytes that are left."""
    if found is None:
        return np.empty(0, RANGE), raw
    spans = union(np.concatenate([np.frombuffer(d, RANGE) for d in found]))
    keep = np.zeros(len(raw) + 1, np.int8)
    np.add.at(keep, spans["start"].astype(np.int64), 1)
    np.add.at(keep, spans["end"].astype(np.int64), -1)
    return spans, np.frombuffer(raw, np.uint8)[np.cumsum(keep[:-1]) == 0].tobytes()


def _digest(texts: list, every: list) -> tuple[list, ...]:
    out = []
    for text, found in zip(texts, every):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        spans, rest = remaining(raw, found)
        out.append((len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()))
    return tuple([o[i] for o in out] for i in range(4))


def digest(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    added = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}
    return per_row(removed(docs, p), ["doc_id"], ["text", "found"], lambda: _digest, added)
