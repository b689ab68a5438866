"""Texts as segments that begin with white space, so that a byte-level tokenizer sees each distinct segment once.

The tokenizers' pattern starts a new match at white space that follows something other
than white space, and nothing before that place looks beyond it. A text is therefore encoded
by its segments. Splitting, numbering and putting the ids together are array operations over many texts at a time; Python
sees the distinct segments only, and the tokenizer those that it has not met before.

Segments are told apart by keys: what follows the space of a segment that begins with one; a line break and what follows it;
a space before any other segment as it stands (keys of the first kind have no space in them).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = [chr(i) for i in range(0x3001) if chr(i).isspace()]
_ODD = "[" + "".join([f"\\x{{{ord(c):x}}}" for c in SPACES]) + "][ \\n]"
_CUT = re.compile(r"(?<=\S)(?=\s)")

#: Bytes of text that are split up at a time.
CHUNK = 6_000_000

#: Segments written one after the other into one text for the tokenizer.
JOINED = 5_000


def literal(key: str) -> str:
    """The segment of a key."""
    head = key[:1]
    return key if head == "\n" else key[1:] if head == " " else " " + key


def _keys(text: str) -> list[str]:
    first, *rest = _CUT.split(text)
    return [first, *[p[1:] if p[0] == " " and p[1:2] not in (" ", "\n") else p if p[0] == "\n" else " " + p for p in rest]]


def split(texts: pa.Array) -> pa.ListArray:
    """The first segment of each text as it stands, and the keys of the others."""
    parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
    if not odd.any():
        return parts
    cut = pa.array([_keys(t) for t in texts.filter(pa.array(odd)).to_pylist()], parts.type)
    place = np.empty(len(odd), np.int64)
    place[~odd], place[odd] = np.arange((~odd).sum()), (~odd).sum() + np.arange(odd.sum())
    return pa.concat_arrays([parts.filter(pa.array(~odd)), cut]).take(pa.array(place))


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[pa.Array]:
    """Runs of texts of about so many bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield texts.slice(at, upto - at)
        at = upto


class Table:
    """Lists of ids under keys, in one array; ``gather`` puts many of them together."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.start, self.count = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, keys: list[str], ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """New entries at the end; their places."""
        first = len(self.start)
        self.index.update(zip(keys, range(first, first + len(keys))))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.flat = np.concatenate((self.flat, ids.astype(np.uint32)))
        return first + np.arange(len(count))

    def places(self, keys: list[str], learn: Callable[[list[str]], None]) -> np.ndarray:
        """Where the keys are, after ``learn`` has added those that were not there."""
        found = list(map(self.index.get, keys))
        missing = [i for i, f in enumerate(found) if f is None]
        if missing:
            learn([keys[i] for i in missing])
            for i in missing:
                found[i] = self.index[keys[i]]
        return np.array(found, np.int64)

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the entries one after the other, and how many each has."""
        count = self.count[places]
        at = np.repeat(self.start[places] - (np.cumsum(count) - count), count)
        at += np.arange(len(at))
        return self.flat[at], count


def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of so many values (at least one each)."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0, np.int64)


def _listed(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


class SegmentEncoder:
    """``encode`` gives the ids of each of a list of texts, ``leads`` tells of each id whether its token begins with a space or line break.

    Entries are kept from one call to the next, until there are ``most``. A segment that ends with a comma or full stop behind a
    letter is its beginning and the mark: the pattern never joins the two."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], leads: np.ndarray, most: int = 400_000):
        self.encode, self.leads, self.most = encode, leads, most
        self.table = Table()
        self.marks = dict(zip(",.", encode([",", "."])))

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.encode(texts)
        return np.concatenate([np.empty(0, np.uint32), *found]), np.array([len(f) for f in found], np.int64)

    def _joined(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Segments without white space but at their beginning: one text holds many, cut where a token begins with it."""
        parts = [list(map(literal, keys[i : i + JOINED])) for i in range(0, len(keys), JOINED)]
        flat, count = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for part, ids in zip(parts, self.encode(["".join(p) for p in parts])):
            heads = np.flatnonzero(self.leads[ids])
            n = np.diff(heads, append=len(ids))
            if len(heads) != len(part):
                ids, n = self._each(part)
            flat.append(ids)
            count.append(n)
        return np.concatenate(flat), np.concatenate(count)

    def _learn(self, keys: list[str]) -> None:
        plain, other = [], []
        for k in keys:
            (plain if k and not k[-1].isspace() and k[0] != " " and (k[0] != "\n" or not k[1].isspace()) else other).append(k)
        self.table.add(plain, *self._joined(plain))
        self.table.add(other, *self._each(list(map(literal, other))))

    def _places(self, keys: pa.Array) -> tuple[Table, np.ndarray]:
        """Where the ids of the segments of distinct keys are, in the table with more entries for those that end with a mark."""
        coded = pc.replace_substring_regex(keys, r"(\pL)[,.]$", r"\1").dictionary_encode()
        place = self.table.places(_listed(coded.dictionary), self._learn)[coded.indices.to_numpy(zero_copy_only=False)]
        marked = pc.match_substring_regex(keys, r"\pL[,.]$").to_numpy(zero_copy_only=False)
        stop = pc.ends_with(keys, ".").to_numpy(zero_copy_only=False)
        more = Table()
        more.flat, more.start, more.count = self.table.flat, self.table.start, self.table.count
        for mark, which in ((",", marked & ~stop), (".", marked & stop)):
            ids = self.marks[mark]
            flat, count = self.table.gather(place[which])
            place[which] = more.add([], np.insert(flat, np.repeat(np.cumsum(count), len(ids)), np.tile(ids, len(count))), count + len(ids))
        return more, place

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        if len(self.table.index) > self.most:
            self.table = Table()
        parts = split(texts)
        sizes = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        heads = np.cumsum(sizes) - sizes
        every = parts.flatten()
        firsts = every.take(pa.array(heads))
        behind = np.ones(len(every), bool)
        behind[heads] = False
        coded = every.filter(pa.array(behind)).dictionary_encode()
        del every, parts
        table, place = self._places(coded.dictionary)
        flat, count = table.gather(place[coded.indices.to_numpy(zero_copy_only=False)])
        first, n_first = self._each(_listed(firsts))
        # the first segment of each text goes before its others
        all_counts = np.zeros(len(behind), np.int64)
        all_counts[behind] = count
        n = summed(all_counts, sizes)
        return np.insert(flat, np.repeat(np.cumsum(n) - n, n_first), first), n + n_first


def strings(column: pa.Array) -> pa.Array:
    """Texts with null read as empty."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def packed(values: np.ndarray, counts: np.ndarray, kind: str) -> pa.Array:
    """Runs of so many values as binary, little-endian."""
    width = np.dtype(kind).itemsize
    offsets = np.concatenate(([0], np.cumsum(counts))) * width
    return pa.Array.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values, kind))]
    ).cast(pa.binary())
