"""Token-id files: canonical length-limited Huffman code from global counts, in independent blocks.

Three passes. (1) Each whole text is tokenized where it is read; the ids travel to
their range of doc_id, are sorted, and are cut into blocks of whole documents with about ``block_tokens``
ids (a longer document is a block of its own). (2) Ids are counted over all blocks and the
code is built from the counts: at most one row an id of the vocabulary reaches the
driver. (3) Each block is packed on its own and written, one folder a range.

A row of the files is a block: ``part`` and ``block`` (its place), ``first`` (ids before it,
over the whole corpus), ``doc_ids`` and ``lengths``, ``payload`` (bits, first bit
highest), ``checkpoints`` (little-endian uint32 bit offsets of every ``STRIDE``-th id). The code
book (id, length) lies beside them; lengths alone give the canonical code. Decoding looks
up ``limit`` bits in a table and runs all checkpoints of a block side by side.

Defined cases: null is an empty text (the end id only); rows with the same doc_id, or none,
are kept as separate documents next to each other (null first), ordered by their ids; an empty
table gives files without blocks; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.llm.segments import SegmentEncoder, chunks, packed, strings
from assayframe.sources.session import new_table_path, release, settle

STRIDE = 256


@dataclass(frozen=True)
class Format:
    """Parameters: the tokenizer file, the id that ends a document, block size in ids, longest code in bits (at most 25)."""

    tokenizer: str
    end_id: int = 0
    block_tokens: int = 131_072
    limit: int = 16


# --- the code ---------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal lengths of at most ``limit`` bits by coin packages (0 for ids that do not occur)."""
    ids = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(ids) <= 1:
        lengths[ids] = 1
        return lengths
    if len(ids) > 1 << limit:
        raise ValueError(f"{len(ids)} ids do not fit into codes of {limit} bits")
    ids = ids[np.argsort(counts[ids], kind="stable")]
    coins = counts[ids].astype(np.int64)
    rows = []  # of each bit: which of the items in order of value are coins
    packages = np.empty(0, np.int64)
    for _ in range(limit):
        values = np.concatenate((coins, packages))
        order = np.argsort(values, kind="stable")
        rows.append(order < len(coins))
        values = values[order]
        packages = values[0 : len(values) // 2 * 2 : 2] + values[1 : len(values) // 2 * 2 : 2]
    take = 2 * len(ids) - 2
    for is_coin in reversed(rows):
        n = int(is_coin[:take].sum())
        lengths[ids[:n]] += 1  # the coins taken are the cheapest ones
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    codes = np.zeros(len(lengths), np.uint64)
    if len(ids):
        top = int(lengths.max())
        steps = np.left_shift(np.uint64(1), (top - lengths[ids]).astype(np.uint64))
        at = np.concatenate(([np.uint64(0)], np.cumsum(steps)[:-1]))
        codes[ids] = at >> (top - lengths[ids]).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Length (top 8 bits) and id for every value of the longest code's number of bits."""
    top = int(lengths.max(initial=1))
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    wide = 1 << (top - lengths[ids])
    table = np.full(1 << top, 1 << 24, np.uint32)
    table[: wide.sum()] = np.repeat((lengths[ids] << 24) | ids, wide)
    return table, top


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """Payload and checkpoints of a block."""
    size = lengths[ids]
    end = np.cumsum(size)
    offset = end - size
    bits = int(end[-1]) if len(ids) else 0
    words = np.zeros(bits // 64 + 2, np.uint64)
    if bits:
        high = codes[ids] << (64 - size).astype(np.uint64)
        word, shift = offset >> 6, (offset & 63).astype(np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words[word[starts]] = np.bitwise_or.reduceat(high >> shift, starts)
        over = np.flatnonzero((offset & 63) + size > 64)
        words[word[over] + 1] |= high[over] << (np.uint64(64) - shift[over])
    return words.astype(">u8").tobytes()[: (bits + 7) // 8], offset[::STRIDE].astype("<u4").tobytes()


def unpack(payload: bytes, checkpoints: bytes, n: int, decode: tuple[np.ndarray, int]) -> np.ndarray:
    """The ids of a block: one lane a checkpoint, all lanes a step at a time."""
    table, top = decode
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = np.frombuffer(checkpoints, "<u4").astype(np.uint32)
    out = np.empty((min(STRIDE, n), len(at)), np.uint32)
    seven, three, high = np.uint32(7), np.uint32(3), np.uint32(24)
    for k in range(len(out)):
        word = window.take(at >> three, mode="clip")
        out[k] = table[(word << (at & seven)) >> np.uint32(32 - top)]
        at += out[k] >> high
    return out.T.reshape(-1)[:n] & np.uint32(0xFFFFFF)


# --- the jobs ---------------------------------------------------------------------------------


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def text_encoder(path: str) -> SegmentEncoder:
    """Ids of texts by a byte-level tokenizer file, in which the letters U+0120 and U+010A stand for the space and the line break."""
    tokenizer = _tokenizer(path)
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    leads = np.zeros(max(vocab.values()) + 1, bool)
    leads[[i for token, i in vocab.items() if token[:1] in ("\u0120", "\u010a")]] = True

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return SegmentEncoder(encode, leads)


@lru_cache(maxsize=1)
def kept_encoder(path: str) -> SegmentEncoder:
    """The encoder of this worker: its tasks share what it has learned."""
    return text_encoder(path)


def id_kind(fmt: Format) -> str:
    """Ids of two bytes where the vocabulary allows."""
    return "<u2" if max(_tokenizer(fmt.tokenizer).get_vocab_size(), fmt.end_id + 1) <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, fmt: Format, kind: str, bounds: list[int]) -> DataFrame:
    """doc_id, its range among the bounds, ids with the end id."""
    path, end = fmt.tokenizer, fmt.end_id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept_encoder(path)
        for batch in batches:
            done = 0
            for texts in chunks(strings(batch.column("text"))):
                ids, n = encode(texts)
                doc_ids = batch.column("doc_id").slice(done, len(texts)).cast(pa.int64())
                part = np.searchsorted(bounds, doc_ids.fill_null(-(2**63)).to_numpy(), "left").astype(np.int32)
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(part), packed(np.insert(ids, np.cumsum(n), end), n + 1, kind)], ["doc_id", "part", "ids"])
                done += len(texts)
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, part int, ids binary")


def blocks(ranged: DataFrame, fmt: Format, kind: str) -> DataFrame:
    """Blocks of the sorted ranges; ``first`` counts from the start of the range."""
    size = np.dtype(kind).itemsize

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, number, first, total = [], 0, 0, 0

        def block() -> pd.DataFrame:
            lengths = [len(r[2]) // size for r in held]
            return pd.DataFrame(
                {"part": [held[0][1]], "block": [number], "first": [first], "doc_ids": [[r[0] for r in held]], "lengths": [lengths], "ids": [b"".join(r[2] for r in held)]}
            )

        for frame in frames:
            numbers = [None if pd.isna(d) else int(d) for d in frame["doc_id"]]
            for row in zip(numbers, frame["part"], frame["ids"]):
                n = len(row[2]) // size
                if held and total + n > fmt.block_tokens:
                    yield block()
                    held, number, first, total = [], number + 1, first + total, 0
                held.append(row)
                total += n
        if held:
            yield block()

    return ranged.mapInPandas(run, "part int, block int, first long, doc_ids array<long>, lengths array<long>, ids binary")


def id_counts(raw: DataFrame, kind: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for frame in frames:
            for ids in frame["ids"]:
                n = np.bincount(np.frombuffer(ids, kind), minlength=len(total))
                n[: len(total)] += total
                total = n
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    return raw.select("ids").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, fmt: Format) -> None:
    """Write the blocks under ``path``/blocks and the code book under ``path``/code."""
    spark = docs.sparkSession
    kind = id_kind(fmt)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n_parts for k in range(1, n_parts)] or [1.0], 100 * n_parts)).first()[0] or []
    bounds = sorted(set(cuts))
    ranged = tokenized(docs, fmt, kind, bounds).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("doc_id", "ids")
    raw = settle(blocks(ranged, fmt, kind), "token-ids")
    counted = id_counts(raw, kind).collect()  # at most one row an id of the vocabulary
    counts = np.zeros(max((r["id"] for r in counted), default=0) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, fmt.limit)
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id long, length int").coalesce(1).write.parquet(f"{path}/code")
    ends = raw.groupBy("part").agg(F.max(F.col("first") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    totals = dict(ends)  # a number a range
    before, at = {}, 0
    for part in sorted(totals):
        before[part], at = at, at + totals[part]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = canonical(lengths)
        for frame in frames:
            packed = [pack(np.frombuffer(ids, kind), lengths, codes) for ids in frame.pop("ids")]
            frame["first"] += frame["part"].map(before)
            frame["payload"], frame["checkpoints"] = [p[0] for p in packed], [p[1] for p in packed]
            yield frame

    schema = "part int, block int, first long, doc_ids array<long>, lengths array<long>, payload binary, checkpoints binary"
    raw.mapInPandas(run, schema).sortWithinPartitions("part", "block").write.partitionBy("part").option("compression", "none").parquet(f"{path}/blocks")
    release(raw)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the ids (little-endian uint32) of every document in the files."""
    book = spark.read.schema("id long, length int").parquet(f"{path}/code").collect()
    lengths = np.zeros(max((r["id"] for r in book), default=0) + 1, np.int64)
    for r in book:
        lengths[r["id"]] = r["length"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = decode_table(lengths)
        for frame in frames:
            for row in frame.itertuples(index=False):
                sizes = np.asarray(row.lengths, np.int64)
                ids = unpack(row.payload, row.checkpoints, int(sizes.sum()), decode).astype("<u4")
                ends = np.cumsum(sizes)
                yield pd.DataFrame(
                    {
                        "doc_id": pd.Series([None if pd.isna(d) else int(d) for d in row.doc_ids], dtype="Int64"),
                        "start": row.first + ends - sizes,
                        "n_tokens": sizes,
                        "ids": [ids[e - n : e].tobytes() for e, n in zip(ends, sizes)],
                    }
                )

    schema = "block int, first long, doc_ids array<long>, lengths array<long>, payload binary, checkpoints binary"
    stored = spark.read.schema(schema + ", part int").parquet(f"{path}/blocks")
    return stored.select("first", "doc_ids", "lengths", "payload", "checkpoints").mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, fmt: Format) -> DataFrame:
    """Write the files to the shared scratch area and digest what is read back from them."""
    spark = docs.sparkSession
    path = new_table_path(spark, "token-files")
    write(docs, path, fmt)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def plain_crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
