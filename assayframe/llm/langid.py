"""Language identification by rank-order profiles of n-grams and out-of-place distance.

A profile is the list of the ``n_ranks`` most frequent letter n-grams (one to three
letters, a word edge counts as a letter) in order of frequency, ties by code. A
document is compared with each language by the sum over its own list of how far
each n-gram is out of place, an n-gram that the language lacks counting as
``n_ranks``. Lower case; everything but letters is a word edge.

Profiles are fitted on all documents given. Prediction
reads every whole text and uses nothing but the text.

``limits`` says from which score on a text is in its language at all: all labelled documents, and what they begin with
up to 1, 2, 4 ... words, are scored, and the limit of a language and number of different n-grams (by powers of two) is
``SPREADS`` times as far below the median as the twentieth part with the lowest scores begins. So it is loose for
short texts, whose scores spread, and strict for long ones; it rises no further once a text fills a whole list.

Defined cases: a null text, or one without letters, is ``und`` with score 0, as is
everything when nothing could be learned; equal distances go to the first language
by code point; repeated rows are predicted one by one; an empty table gives an empty
result; other columns are ignored. Null languages are never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayframe.llm.common import per_row
from assayframe.operators.ranking import exact_quantiles
from assayframe.sources.session import settle

N_RANKS = 300
UNKNOWN = "und"
#: Texts whose n-grams a task lists at a time, and different ones that it holds counts of before it sends them on.
COUNT_TEXTS = 200
COUNT_CODES = 500_000
#: Scores a limit needs; its distance; the limit if there are too few.
LEAST_SCORES = 20
SPREADS = 4.5
LEAST_SCORE = 0.1
#: Powers of two that the number of n-grams of a text can have.
POWERS = 40


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams: 21 bits a letter, a letter being its code point plus one and an edge one."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.concatenate(([0], np.where(_letters()[points], points, 0), [0])).astype(np.int64)
    points = points[np.concatenate(([True], (points[1:] != 0) | (points[:-1] != 0)))]
    code = points + 1
    pairs = (code[:-1] << 21) | code[1:]
    triples = (pairs[:-1] << 21) | code[2:]
    if len(points) < 2:
        return np.empty(0, np.int64)
    return np.concatenate((code[points != 0], pairs, triples[points[1:-1] != 0]))


def in_order(codes: np.ndarray) -> np.ndarray:
    """The different codes in order of frequency, ties by code."""
    values, counts = np.unique(codes, return_counts=True)
    return values[np.lexsort((values, -counts))]


def ranked(codes: np.ndarray, n_ranks: int) -> np.ndarray:
    """The most frequent codes in order of frequency, ties by code."""
    return in_order(codes)[:n_ranks]


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the n-grams of each language, added up as long as a task can hold them."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def sent(lang: str) -> pd.DataFrame:
        values, counts = held.pop(lang)
        return pd.DataFrame({"lang": lang, "code": values, "n": counts})

    for frame in frames:
        for lang, texts in frame.groupby("lang")["text"]:
            for at in range(0, len(texts), COUNT_TEXTS):
                new = np.unique(np.concatenate([ngrams(t) for t in texts.iloc[at : at + COUNT_TEXTS]]), return_counts=True)
                if lang in held:
                    values, spot = np.unique(np.concatenate((held[lang][0], new[0])), return_inverse=True)
                    counts = np.zeros(len(values), np.int64)
                    np.add.at(counts, spot, np.concatenate((held[lang][1], new[1])))
                    new = values, counts
                held[lang] = new
                if len(new[0]) > COUNT_CODES:
                    yield sent(lang)
    for lang in list(held):
        yield sent(lang)


def profiles(labelled: DataFrame, n_ranks: int = N_RANKS) -> DataFrame:
    """lang, code, place (from 0) of the documents given (doc_id, text, lang)."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = labelled.mapInPandas(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "code")
    return counts.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < n_ranks).select("lang", "code", "place")


def predict(docs: DataFrame, profile: DataFrame, n_ranks: int = N_RANKS, text: str = "text", counted: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score, and ``power``, the binary logarithm of the number of different n-grams, if ``counted``. ``text`` is a column, which is
    left out, or a field of a struct, which stays.

    The profiles that travel to the tasks are ``n_ranks`` rows a language."""
    rows = profile.collect()
    langs = sorted({r["lang"] for r in rows})
    known = np.unique(np.array([r["code"] for r in rows], np.int64))
    places = np.full((len(langs), len(known) + 1), n_ranks, np.int64)
    at = {lang: i for i, lang in enumerate(langs)}
    for r in rows:
        places[at[r["lang"]], np.searchsorted(known, r["code"])] = r["place"]
    shared = docs.sparkSession.sparkContext.broadcast((langs, known, places))

    def make():
        langs, known, places = shared.value

        def one(text: str | None) -> tuple[str, float, int]:
            codes = ngrams(text) if text and langs else ()
            if len(codes) == 0:
                return UNKNOWN, 0.0, 0
            different = in_order(codes)
            own = different[:n_ranks]
            spot = np.minimum(np.searchsorted(known, own), len(known) - 1)
            spot = np.where(known[spot] == own, spot, len(known))
            there = places[:, spot]
            far = np.where(there == n_ranks, n_ranks, np.abs(there - np.arange(len(own)))).sum(1)
            best = int(far.argmin())
            return langs[best], 1.0 - float(far[best]) / (n_ranks * len(own)), len(different).bit_length() - 1

        def compute(texts: list) -> tuple[list, ...]:
            found = [one(t) for t in texts]
            return tuple([f[i] for f in found] for i in range(len(added)))

        return compute

    kept = [c for c in docs.columns if c != text]
    added = {"lang_pred": "string", "score": "double"} | ({"power": "long"} if counted else {})
    return per_row(docs, kept, [text], make, added)


def limits(labelled: DataFrame, profile: DataFrame, least_scores: int = LEAST_SCORES, spreads: float = SPREADS) -> DataFrame:
    """lang_pred, power, least: the lowest score of each language learned for each power of two n-grams.

    Too few scores: those of all languages are taken, or else the limit of the next smaller number of n-grams, or larger one."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    last = F.ceil(F.log2(F.length("text") - F.length(F.replace("text", F.lit(" "))) + 1)).cast("int")
    cuts = labelled.select("text", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    scored = predict(cuts.select(F.expr("substring_index(text, ' ', shiftleft(1, k))").alias("text")), profile, counted=True)
    # equal scores are one row; ``every`` marks those of all languages together
    one = scored.where(F.col("lang_pred") != UNKNOWN).groupBy("lang_pred", "power", "score").agg(F.count("*").alias("n"))
    one = settle(one, "langid-scores")
    groups = one.withColumn("every", F.lit(False)).unionByName(one.withColumn("every", F.lit(True)).withColumn("lang_pred", F.lit("")))
    keys = ["every", "lang_pred", "power"]
    sizes = {tuple(r[k] for k in keys): r["n"] for r in groups.groupBy(*keys).agg(F.sum("n").alias("n")).collect()}
    at: dict[tuple, dict[float, float]] = {}
    for r in exact_quantiles(groups, keys, "score", [0.05, 0.5], "n").collect():  # two rows a limit
        at.setdefault(tuple(r[k] for k in keys), {})[r["prob"]] = r["quantile"]
    found = {(None if k[0] else k[1], k[2]): q[0.5] - spreads * (q[0.5] - q[0.05]) for k, q in at.items() if sizes[k] >= least_scores}
    out = []
    for lang in sorted({r["lang"] for r in profile.select("lang").distinct().collect()}):
        own = {p: found.get((lang, p), found.get((None, p))) for p in range(POWERS)}
        known, full = [p for p in range(POWERS) if own[p] is not None], N_RANKS.bit_length() - 1
        for p in range(POWERS):
            nearest = max((k for k in known if k <= p), default=min(known, default=None))
            least = LEAST_SCORE if nearest is None else min(own[k] for k in known if k == nearest or full <= k < nearest)
            out.append((lang, p, max(LEAST_SCORE, float(least))))
    return settle(profile.sparkSession.createDataFrame(out, "lang_pred string, power long, least double"), "langid-limits")


def held_out(doc_id: str = "doc_id"):
    """Every fifth document by the crc32 of its number; a null number is neither held out nor learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    slim = docs.select("doc_id", "text", "lang")
    profile = settle(profiles(slim.where(~held_out())), "langid-profiles")
    flagged = slim.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return predict(flagged, profile)
