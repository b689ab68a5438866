"""Periodic runs against brute force."""

import hashlib
import re
import zlib

import numpy as np
import oracle
import pytest

from assayframe.llm import runs
from assayframe.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    """Maximal stretches with a period, the smallest period of each, by trying every period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e + q - i >= max(least, 2 * q):
                found.setdefault((i, e + q), q)
            i = e
    return sorted((s, e - s, q) for (s, e), q in found.items())


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, *[hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)])


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def rows(df):
    return sorted([tuple(r[c] for c in COLUMNS) for r in df.collect()], key=str)


def pieces(words):
    """One document's runs, by the suffix array."""
    numbers = {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    return [(s, e - s, q) for s, e, q in runs.maximal_runs(codes, np.array([len(words)]), 4).tolist()]


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_of_random_words(letters):
    rng = np.random.default_rng(letters)
    for _ in range(150):
        words = rng.integers(0, letters, rng.integers(1, 70)).tolist()
        if rng.random() < 0.5:
            words = (words * 5)[: rng.integers(1, 120)]
        assert pieces(words) == brute(words, 4)


def test_runs_of_a_fibonacci_word():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert pieces(b) == brute(b, 4)


def test_runs_of_many_documents_do_not_meet():
    rng = np.random.default_rng(9)
    docs = [rng.integers(0, 3, n).tolist() * 2 for n in rng.integers(1, 40, 200)]
    ends = np.cumsum([len(d) for d in docs])
    got = runs.maximal_runs(np.concatenate(docs).astype(np.int64), np.array([len(d) for d in docs]), 4)
    want = [(s + end - len(d), s + n + end - len(d), q) for d, end in zip(docs, ends) for s, n, q in brute(d, 4)]
    assert [tuple(r) for r in got.tolist()] == sorted(want, key=lambda r: (r[0], r[2]))


def test_tests_in_parts(monkeypatch):
    words = ([0, 1] * 9 + [2, 0]) * 4
    want = pieces(words)
    monkeypatch.setattr(runs, "TESTED", 3)
    assert pieces(words) == want


def test_defined_cases(spark):
    rng = np.random.default_rng(2)
    texts = [None, "", " \n\t ", "a", "a " * 40, "a b " * 5 + "a b", "a b " * 6, "\x1c\x85   x" * 9, "w " * 30_000]
    texts += [" ".join(rng.choice(list("abc"), n)) for n in (11, 12, 13, 60, 200)]
    texts += [" ".join(f"w{i % 700}" for i in range(1401)), "été\nle\x0bjour\x0cvoilà " * 7]
    given = [(i, t) for i, t in enumerate(texts)] + [(None, "a b " * 9), (None, None), (3, "a"), (3, "a"), (-5, "x y " * 20)]
    given += [(i, " ".join(f"v{j}" for j in range(i % 97))) for i in range(100, 400)]
    docs = spark.createDataFrame(given, "doc_id long, text string").selectExpr("*", "1 AS n_runs", "'x' AS runs", "2L AS start").repartition(3)
    got = rows(runs.digest(runs.find(docs, change=runs.planted)))
    assert got == sorted([expected(*r) for r in given], key=str)


def test_lists_and_texts(spark):
    docs = spark.createDataFrame([(1, "say " + "na " * 13 + "batman"), (2, "one two")], "doc_id long, text string")
    got = {r.doc_id: r for r in runs.find(docs).collect()}
    assert got[1].runs == [(1, 13, 1)] and got[1].collapsed == "say na batman" and got[2].collapsed == "one two" and got[2].n_words == 2


def test_empty_table(spark):
    assert runs.digest(runs.find(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_query_equals_brute_force(spark):
    sf = f"{oracle.ROOT}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert rows(QUERIES["op11_runs"](spark, sf)) == sorted([expected(*r) for r in docs], key=str)
