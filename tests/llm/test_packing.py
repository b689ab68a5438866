"""Packing against the tokenizers library, the rules of the contract and an exact solver for small inputs."""

import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import oracle
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from assayframe.llm import packing, token_files
from assayframe.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def packed_rightly(rows, docs, capacity):
    """Every token of every document in one place, sequences without gaps; gives their number."""
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
        want += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted([tuple(r)[:5] for r in rows], key=repr) == sorted(want, key=repr)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def fewest(lengths, capacity):
    """Sequences needed, by trying everything."""

    @lru_cache(None)
    def need(left):
        if not left:
            return 0
        best, (first, *rest) = len(left), left

        def fill(k, room, kept):
            nonlocal best
            if k == len(rest):
                best = min(best, 1 + need(kept))
                return
            if rest[k] <= room:
                fill(k + 1, room - rest[k], kept)
            fill(k + 1, room, (*kept, rest[k]))

        fill(0, capacity - first, ())
        return best

    return need(tuple(sorted(lengths, reverse=True)))


def holds(plan, lengths, capacity):
    used = Counter()
    for filling, times in plan:
        assert 0 < sum(filling) <= capacity and times > 0
        for size in filling:
            used[size] += times
    assert used == Counter(lengths)
    return sum(times for _, times in plan)


def counted(lengths, capacity):
    return np.bincount(np.array(lengths, np.int64), minlength=capacity + 1)


@pytest.mark.parametrize("seed", range(40))
def test_small_inputs_take_the_fewest_sequences(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([20, 50, 100]))
    lengths = rng.integers(1, capacity + 1, rng.integers(1, 10)).tolist()
    plan = packing.packed(counted(lengths, capacity), capacity, 20_000)
    assert holds(plan, lengths, capacity) == fewest(lengths, capacity)
    assert packing.lower_bound(counted(lengths, capacity), capacity) <= fewest(lengths, capacity)


def test_best_fit_is_improved():
    # best-fit decreasing takes four sequences, three do: 50 + 30 + 20, 40 + 40 + 20, 40 + 30 + 30
    lengths = [50, 40, 40, 40, 30, 30, 30, 20, 20]
    counts = counted(lengths, 100)
    assert holds(packing.best_fit(counts, 100), lengths, 100) == 4
    assert holds(packing.packed(counts, 100, 20_000), lengths, 100) == 3


@pytest.mark.parametrize("how_many", [1, 17, 400, 30_000])
def test_large_inputs_come_near_the_bound(how_many):
    rng = np.random.default_rng(how_many)
    lengths = np.minimum(rng.geometric(1 / 600, how_many), 2048).tolist()
    counts = counted(lengths, 2048)
    taken = holds(packing.packed(counts, 2048, 20_000), lengths, 2048)
    assert taken <= max(packing.lower_bound(counts, 2048) + 1, 1.002 * packing.lower_bound(counts, 2048))


def test_plan_has_a_place_for_each_piece():
    plan = [((7, 3, 3), 4), ((7, 2), 1), ((3, 3, 3), 2)]
    table = packing.places(plan)
    assert table[table[:, 0] == 3].tolist() == [[3, 0, 2, 0, 7], [3, 8, 3, 5, 0]]
    assert table[table[:, 0] == 7].tolist() == [[7, 0, 1, 0, 0], [7, 4, 1, 4, 0]]


def test_ids_of_segments_are_ids_of_texts():
    tokenizer, encode, rng = Tokenizer.from_file(PATH), token_files.text_encoder(PATH), np.random.default_rng(3)
    letters = [*"ab etionsr.,' \n\té中 \x1c1", "'s", "  ", ", ", ". ", "\n\n", "😀", "Word", "<|endoftext|>", "　", "\r\n"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(1500)]
    for part in (texts[:1], texts[1:700], texts[700:]):
        ids, n = encode(pa.array(part, pa.large_string()))
        assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]


def test_defined_cases(spark):
    rng = np.random.default_rng(6)
    docs = [(i, " ".join(f"w{j}" for j in rng.integers(0, 50, rng.integers(0, 60)))) for i in range(150)]
    docs += [(None, None), (None, "a b"), (None, "a b"), (3, "again"), (3, "again"), (7, ""), (8, None), (9, "long " * 9000)]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS length", "'x' AS piece", "2 AS number").repartition(4)
    rows = packing.pack(table, packing.Packing(PATH, capacity=64)).collect()
    least = packing.lower_bound(counted([r.length for r in rows], 64), 64)
    assert least <= packed_rightly(rows, docs, 64) <= least + 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), packing.Packing(PATH)).collect() == []


def test_query(spark):
    sf = f"{oracle.ROOT}/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op13_packing"](spark, sf).collect()
    taken = packed_rightly(rows, docs, 2048)
    assert taken <= -(-sum(r.length for r in rows) // 2048) + 1


def test_tasks_of_a_worker_share_what_the_encoder_has_learned(spark):
    import pyarrow as pa

    kept = token_files.kept_encoder(PATH)
    assert token_files.kept_encoder(PATH) is kept
    texts = pa.array(["one two, three\nfour", "", "two  five two"], pa.large_string())
    for _ in range(2):
        ids, n = kept(texts)
        fresh_ids, fresh_n = token_files.text_encoder(PATH)(texts)
        assert ids.tolist() == fresh_ids.tolist() and n.tolist() == fresh_n.tolist()
