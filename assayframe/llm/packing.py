"""Packing documents into sequences of a fixed number of tokens by bin completion.

Documents are tokenized where they are read; one that is longer than a sequence is cut into full pieces behind
a first one that may be shorter. How many pieces there are of each length (one number a length, so a few thousand at most,
whatever the input) is all that the choice of fillings needs: it is made by branch and bound on these counts.
Around the largest length left, fillings are enumerated from the least waste on, those that one
piece or a pair of larger ones dominates left out; a filling is used as often as the counts allow, and taken back when the waste
exceeds what a target allows. Targets rise from a lower bound to the incumbent, best-fit decreasing.
The pieces of a length are numbered in order of doc_id, and the number says which place of the plan a piece takes.

Defined cases: a null text is empty, so its document is the end id alone; rows of one doc_id, or of none, are documents of
their own; equal rows take places next to each other; an empty table has no sequences; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.segments import chunks, strings
from assayframe.llm.token_files import text_encoder
from assayframe.operators.ranking import running_totals
from assayframe.sources.session import Scratch

#: A filling (lengths, largest first) and how many sequences take it.
Plan = list[tuple[tuple[int, ...], int]]


@dataclass(frozen=True)
class Packing:
    """Parameters: the tokenizer file, tokens of a sequence, the id that ends a document, places the search looks at for one target."""

    tokenizer: str
    capacity: int = 2048
    end_id: int = 0
    tries: int = 20_000


# --- the choice of fillings -------------------------------------------------------------------


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that are needed at least: for each limit, pieces that leave less room than it stand alone, and
    those from the limit to a half must find room next to the larger ones or in sequences of their own."""
    sizes = np.arange(len(counts))
    best = -(-int((counts * sizes).sum()) // capacity)
    for limit in range(1, capacity // 2 + 1):
        large, middle = counts[capacity - limit + 1 :].sum(), slice(capacity // 2 + 1, capacity - limit + 1)
        room = capacity * counts[middle].sum() - (counts * sizes)[middle].sum()
        small = slice(limit, capacity // 2 + 1)
        rest = int((counts * sizes)[small].sum() - room)
        best = max(best, int(large + counts[middle].sum()) + max(0, -(-rest // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Largest first, each piece where it leaves the least room; sequences that are filled alike move together."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by room: filling, how many
    some = np.zeros(capacity + 1, bool)  # rooms that there are

    def put(room: int, filling: tuple[int, ...], many: int) -> None:
        if many:
            open_.setdefault(room, []).append((filling, many))
            some[room] = True

    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            room = size + int(some[size:].argmax())
            if some[room]:
                filling, many = open_[room].pop()
                some[room] = bool(open_[room])
            else:
                room, filling, many = capacity, (), -(-left // (capacity // size))
            times = room // size  # a sequence that takes one piece stays the closest while another fits
            whole = min(many, left // times)
            left -= whole * times
            put(room - times * size, filling + (size,) * times, whole)
            if many > whole and left:
                put(room - left * size, filling + (size,) * left, 1)
                whole, left = whole + 1, 0
            if filling:
                put(room, filling, many - whole)
    return [entry for held in open_.values() for entry in held]


def _all_fillings(counts: np.ndarray, largest: int, room: int) -> list[tuple[tuple[int, ...], int]]:
    """Every choice of pieces beside the largest that leaves no room for another one, from the least waste on."""
    left = Counter({int(s): int(counts[s]) for s in np.flatnonzero(counts)})
    left[largest] -= 1
    sizes = sorted((s for s in left if left[s]), reverse=True)
    found = []

    def extend(k: int, room: int, chosen: tuple[int, ...]) -> None:
        if k == len(sizes):
            if not any(s <= room and left[s] > chosen.count(s) for s in sizes):
                found.append(((largest, *chosen), room))
            return
        for n in range(min(left[sizes[k]], room // sizes[k]), -1, -1):
            extend(k + 1, room - n * sizes[k], chosen + (sizes[k],) * n)

    extend(0, room, ())
    return sorted(found, key=lambda f: f[1])


#: With so few pieces left, all fillings are listed.
FEW = 16


class Tries:
    """How many more places the search may look at."""

    def __init__(self, left: int):
        self.left = left


def fillings(counts: np.ndarray, largest: int, capacity: int, slack: int, tries: Tries) -> Iterator[tuple[tuple[int, ...], int]]:
    """Fillings around the largest piece and the waste they leave (``slack`` at most), from the least waste on. While two
    of the next largest pieces fit with room to spare, one is taken; the last up to three are chosen. ``counts`` must be the same
    whenever the next filling is asked for."""
    room = capacity - largest
    if counts.sum() <= FEW:
        tries.left -= 1
        yield from (f for f in _all_fillings(counts, largest, room) if f[1] <= slack)
        return
    used = Counter([largest])
    has = counts > 0
    has[largest] = counts[largest] > 1
    head: tuple[int, ...] = (largest,)
    while True:
        small = np.flatnonzero(has[: room + 1])
        if not len(small):
            if room <= slack:
                yield head, room
            return
        top = int(small[-1])
        if room <= 2 * top:
            break
        head += (top,)
        room -= top
        used[top] += 1
        has[top] = counts[top] > used[top]

    def fits(*chosen: int) -> bool:
        return all(counts[p] - used[p] >= n for p, n in Counter(chosen).items())

    def pairs(total: int, most: int) -> Iterator[tuple[int, int]]:
        low, high = -(-total // 2), min(total - 1, most)
        tries.left -= 1
        if high >= low:
            both = has[low : high + 1] & has[total - high : total - low + 1][::-1]
            for k in np.flatnonzero(both)[::-1].tolist():
                yield low + k, total - low - k

    for waste in range(0, min(slack, room - 1) + 1):
        total = room - waste
        if has[total]:
            yield (*head, total), waste
            return  # one piece dominates all that could take its place
        for a, b in pairs(total, top):
            if fits(a, b):
                yield (*head, a, b), waste
        for a in small[::-1].tolist():
            if tries.left <= 0:
                return
            if a < total <= 3 * a:
                for b, c in pairs(total - a, a):
                    if fits(a, b, c):
                        yield (*head, a, b, c), waste


def completed(counts: np.ndarray, capacity: int, target: int, tries: Tries) -> Plan | None:
    """A plan of ``target`` sequences at most, None if none is found in so many tries. The search goes deep first, so that what is taken
    back first is what was chosen last, when few pieces are left."""
    counts = counts.copy()
    slack = target * capacity - int((counts * np.arange(len(counts))).sum())
    plan: Plan = []
    open_: list[tuple[Iterator, int]] = []  # of each step its fillings and what the choice made has wasted
    while slack >= 0 and tries.left > 0:
        left = np.flatnonzero(counts)
        if not len(left):
            return plan
        choices, spent = fillings(counts, int(left[-1]), capacity, slack, tries), 0
        while True:
            filling, waste = next(choices, ((), 0))
            if filling:
                break
            if not open_:
                return None
            # no filling is left here: take back the step before
            choices, spent = open_.pop()
            back, times = plan.pop()
            for size, n in Counter(back).items():
                counts[size] += n * times
            slack += spent
        need = Counter(filling)
        times = min(int(counts[size]) // n for size, n in need.items())
        if waste:
            times = min(times, slack // waste)
        for size, n in need.items():
            counts[size] -= n * times
        slack -= waste * times
        plan.append((filling, times))
        open_.append((choices, waste * times))
    return None


def packed(counts: np.ndarray, capacity: int, tries: int) -> Plan:
    """Fillings for ``counts[length]`` pieces of each length up to the capacity."""
    counts = np.asarray(counts, np.int64)
    full = int(counts[capacity]) if len(counts) > capacity else 0
    rest = counts.copy()
    rest[capacity:] = 0
    plan = best_fit(rest, capacity)
    bound, most = lower_bound(rest, capacity), sum(n for _, n in plan)
    more = 0
    while bound + more < most:
        found = completed(rest, capacity, bound + more, Tries(tries))
        if found is not None:
            plan = found
            break
        more = 2 * more or 1
    return [((capacity,), full)] * (full > 0) + plan


# --- the jobs ---------------------------------------------------------------------------------


def pieces(docs: DataFrame, how: Packing) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    path, end, capacity = how.tokenizer, how.end_id, how.capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(path)
        for batch in batches:
            done = 0
            for texts in chunks(strings(batch.column("text"))):
                ids, n = encode(texts)
                ids, n = np.insert(ids, np.cumsum(n), end).astype("<u4"), n + 1
                many = -(-n // capacity)
                owner = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
                first = n - (many - 1) * capacity
                start = np.where(piece > 0, first[owner] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[owner])
                at = (np.cumsum(n) - n)[owner] + start
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                doc_ids = batch.column("doc_id").slice(done, len(texts)).cast(pa.int64()).take(pa.array(owner))
                arrays = [doc_ids, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])
                done += len(texts)
        del encode
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def places(plan: Plan) -> np.ndarray:
    """One row a filling and length in it, in order of length: length, number of the first piece, pieces in a sequence, the first
    sequence, where the pieces of the length begin in it."""
    rows, taken, sequence = [], Counter(), 0
    for filling, times in plan:
        offset = 0
        for size, n in sorted(Counter(filling).items(), reverse=True):
            rows.append((size, taken[size], n, sequence, offset))
            taken[size] += n * times
            offset += n * size
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, how: Packing) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    scratch = Scratch()
    held = scratch.settle(pieces(docs, how), "packing-pieces")
    counted = held.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most one row a length
    counts = np.zeros(how.capacity + 1, np.int64)
    for r in counted:
        counts[r["length"]] = r["n"]
    table = places(packed(counts, how.capacity, how.tries))
    numbered = running_totals(held, ["doc_id", "piece", "ids_crc32"], {"number": F.lit(1).cast("bigint")}, ["length"], rows=int(counts.sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the row of the plan with this length and the last first number up to the piece's
        width = int(table[:, 1].max(initial=0)) + 1
        keys = table[:, 0] * width + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy() - 1
            row = np.searchsorted(keys, length * width + np.minimum(number, width - 1), "right") - 1
            _, first, many, sequence, offset = table[row].T
            at = number - first
            arrays = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            arrays += [pa.array(sequence + at // many), pa.array(offset + at % many * length)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(run, schema)
