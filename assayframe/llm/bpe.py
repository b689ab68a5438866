"""Byte-level BPE encoding by merge replay, and decoding.

The texts of a task are read as one corpus, some megabytes at a time: distinct segments are split into words by the
pattern, and the distinct words not met before are encoded together. All their bytes lie in one
linked list; an inverted index maps each pair that can merge (named by the rank of the
merged token) to its positions in all words. The ranks are replayed from a heap in ascending
order, each merge touching its two neighbours only, which leave and enter the index. One replay of a rank
merges its first place in every word; further places in a word come after the pairs of lower rank
that the first merge may have made: that is the order in which the same word would be merged on its own, so the ids
are those of any rank-based encoder.

Nothing is shuffled: every task encodes what it reads, so losing an executor costs its tasks only.

Defined cases: null is an empty text, without ids; repeated rows are encoded one by one; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from assayframe.llm.common import per_row
from assayframe.llm.segments import SegmentEncoder, Table, chunks, packed, strings


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class MergeReplay:
    """Encodes lists of words (bytes) with the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], most: int = 300_000):
        self.ranks, self.most = ranks, most
        self.token = {r: t for t, r in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)])
        self.first = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])
        self.pairs: dict[int, int] = {}  # looked up before: left << 32 | right

    def _merged(self, pairs: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that pairs make, -1 where there is none."""
        keys = pairs.tolist()
        found = list(map(self.pairs.get, keys))
        if None in found:
            if len(self.pairs) > self.most:
                self.pairs = {}
            for i, (key, rank) in enumerate(zip(keys, found)):
                if rank is None:
                    found[i] = self.pairs[key] = self.ranks.get(self.token[key >> 32] + self.token[key & 0xFFFFFFFF], -1)
        return np.array(found, np.int64)

    def _replayed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each has."""
        # one list for all words, -1 between them
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        owner = np.repeat(np.arange(len(words)), sizes)
        at = np.arange(len(data)) + owner + 1
        n = len(data) + len(words) + 1
        token, word, pair = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        token[at], word[at] = self.byte[data], owner
        pair[at[:-1]] = np.where(owner[1:] == owner[:-1], self.first[data[:-1], data[1:]], -1)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}  # of each rank the places whose pair makes it, now or earlier
        heap: list[int] = []

        def enter(ranks: np.ndarray, places: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for rank, a, b in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:]):
                if rank in index:
                    index[rank].append(places[a:b])
                else:
                    index[rank] = [places[a:b]]
                    heapq.heappush(heap, rank)

        able = np.flatnonzero(pair >= 0)
        if len(able):
            enter(pair[able], able)
        while heap:
            rank = heapq.heappop(heap)
            places = np.unique(np.concatenate(index.pop(rank)))
            places = places[pair[places] == rank]  # the others have taken part in another merge since
            if not len(places):
                continue
            first = np.ones(len(places), bool)
            first[1:] = word[places[1:]] != word[places[:-1]]
            if not first.all():
                # the rest of a word waits for pairs of lower rank that its first merge may make
                index[rank] = [places[~first]]
                heapq.heappush(heap, rank)
                places = places[first]
            gone = after[places]
            right, left = after[gone], before[places]
            token[places], token[gone], pair[gone], pair[places] = rank, -1, -1, -1
            after[places], before[right] = right, places
            has_left, has_right = token[left] >= 0, token[right] >= 0
            touched = np.concatenate((left[has_left], places[has_right]))
            if not len(touched):
                continue
            made = self._merged(np.concatenate((token[left[has_left]] << 32 | rank, rank << 32 | token[right[has_right]])))
            pair[touched] = made
            able = made >= 0
            if able.any():
                enter(made[able], touched[able])
        live = token >= 0
        return token[live], np.bincount(word[live], minlength=len(words))

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        known = whole >= 0
        count = known.astype(np.int64)
        open_ = [i for i in np.flatnonzero(~known).tolist() if words[i]]
        if open_:
            ids, count[open_] = self._replayed([words[i] for i in open_])
        flat = np.empty(int(count.sum()), np.int64)
        of_known = np.repeat(known, count)
        flat[of_known] = whole[known]
        if open_:
            flat[~of_known] = ids
        return flat, count


class Encoder:
    """Texts to ids; keeps the ids of words and segments it has met, in tables emptied when full."""

    def __init__(self, path: str, pattern: str, most: int = 250_000):
        self.ranks = load_ranks(path)
        self.replay = MergeReplay(self.ranks)
        self.find = regex.compile(pattern).findall
        self.most = most
        self.words = Table()
        leads = np.zeros(max(self.ranks.values()) + 1, bool)
        leads[[r for t, r in self.ranks.items() if t[:1] in (b" ", b"\n")]] = True
        self.segments = SegmentEncoder(self._texts, leads, most)

    def _texts(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.find(t) for t in texts]
        if len(self.words.index) > self.most:
            self.words = Table()
        every = list(chain.from_iterable(split))
        ids, count = self.words.gather(self.words.places(every, self._learn))
        ends = np.concatenate(([0], np.cumsum(count)))[np.cumsum([len(s) for s in split], dtype=np.int64)]
        return np.split(ids, ends[:-1]) if len(split) else []

    def _learn(self, words: list[str]) -> None:
        new = list(dict.fromkeys(words))
        self.words.add(new, *self.replay([w.encode("utf-8") for w in new]))

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not texts:
            return []
        ids, n = self.segments(pa.array(texts, pa.large_string()))
        return [part.tolist() for part in np.split(ids, np.cumsum(n)[:-1])]


class Decoder:
    """Ids to bytes and to decimal text."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(i) for i in range(len(self.bytes_of))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def hashes(self, ids: list[int]) -> tuple[str, str]:
        """Of the ids, written in decimal, and of the bytes decoded from them."""
        plain = ",".join(map(self.text_of.__getitem__, ids)).encode()
        return hashlib.sha256(plain).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def _encoded(docs: DataFrame, path: str, pattern: str, added: list[str], make: Callable) -> DataFrame:
    """doc_id, n_tokens and the columns that ``make()`` gives for the ids of a run of texts and their numbers."""
    fields = {"ids": "binary", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = ", ".join(["doc_id long", "n_tokens long", *(f"{f} {fields[f]}" for f in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, columns = Encoder(path, pattern), make()
        for batch in batches:
            done, doc_ids = 0, batch.column("doc_id")
            for texts in chunks(strings(batch.column("text"))):
                ids, n = coder.segments(texts)
                arrays = [doc_ids.slice(done, len(texts)).cast(pa.int64()), pa.array(n), *columns(ids, n)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", *added])
                done += len(texts)
        # workers live on: what this task held is given back before the next stage begins
        del coder
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32)."""
    return _encoded(docs, path, pattern, ["ids"], lambda: lambda ids, n: [packed(ids, n, "<u4")])


def round_trip(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32) if wanted, ids_sha256 (of the ids written in decimal) and
    decoded_sha256 (of the bytes decoded from the ids), in one step."""

    def make() -> Callable:
        decoder = Decoder(path)

        def columns(ids: np.ndarray, n: np.ndarray) -> list[pa.Array]:
            found = [decoder.hashes(part.tolist()) for part in np.split(ids, np.cumsum(n)[:-1])]
            return [*[packed(ids, n, "<u4")] * keep_ids, pa.array([f[0] for f in found]), pa.array([f[1] for f in found])]

        return columns

    return _encoded(docs, path, pattern, [*["ids"] * keep_ids, "ids_sha256", "decoded_sha256"], make)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, decoded (bytes). ``pattern`` is not needed: the ids say all."""

    def make():
        decoder = Decoder(path)
        return lambda ids: ([decoder.decode(np.frombuffer(i, "<u4").tolist()) for i in ids],)

    return per_row(encoded, ["doc_id", "n_tokens"], ["ids"], make, {"decoded": "binary"})


def digest(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Hashes of the ids and of the bytes decoded from them, for ids that are stored already."""

    def make():
        decoder = Decoder(path)

        def compute(every: list) -> tuple[list, list]:
            found = [decoder.hashes(np.frombuffer(raw, "<u4").tolist()) for raw in every]
            return [f[0] for f in found], [f[1] for f in found]

        return compute

    return per_row(encoded, ["doc_id", "n_tokens"], ["ids"], make, {"ids_sha256": "string", "decoded_sha256": "string"})
