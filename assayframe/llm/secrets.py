"""Secret scan: fixed rules, plus a character convolutional network over every candidate.

Each whole text is read once. The rules give the base findings; every run of 12 or
more token characters with a digit in it, or in mixed case, is a candidate, kept with the
characters around it. The network (numpy: one-hot characters, one layer of filters
of width 5, maximum over positions, logistic output) sees candidate and context with
the keyword blotted out in half of the training views, so that it learns what a secret
looks like as well as how it is announced. Labelled findings: candidates that a rule
confirms against those it does not (each stretch of up to 40 characters once), all of them: they are dealt by hash to parts of
some thousands, and the weights that an epoch over each part ends with are averaged, which is where the next epoch begins.
The scores of a held-out third are calibrated by Platt scaling, and the threshold is the highest that still finds ``recall`` of
the held-out secrets (``precision`` is what it costs there); what is above it is added. A longer candidate is seen in
overlapping views, and the highest score counts; what a rule leaves over of a candidate is scored as well.

Defined cases: null is an empty text without findings; repeated rows are scanned one
by one; without both kinds of labelled candidates nothing is added; an empty table
gives an empty result; other columns are ignored. Positions are code points.
"""

from __future__ import annotations

import copy
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import per_row
from assayframe.operators.ranking import global_rank
from assayframe.sources.session import settle

# The three rules and the least lengths of their findings.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the leftmost run of 32 or more is a whole run
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "model")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
MIXED = re.compile(r"[0-9]|[a-z].*[A-Z]|[A-Z]{2}.*[a-z]")

LEFT, RIGHT, BODY = 24, 8, 40
SYMBOLS, BLANK = 12, 10


@dataclass(frozen=True)
class Net:
    """Parameters; ``part`` is the number of labelled candidates, about, that one step of the fit on Spark goes over."""

    part: int = 8_000
    filters: int = 24
    width: int = 5
    epochs: int = 30
    rate: float = 0.05
    recall: float = 0.99
    seed: int = 7


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed rules, in order."""
    found = []
    low = text.encode("utf-8", "surrogatepass").lower()  # ASCII letters only
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"akia" in low:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def views(text: str, s: int, e: int) -> list[str]:
    """What the network sees of a stretch: BODY characters with those around them, for a longer stretch again every half BODY."""
    starts = range(s, max(s + 1, e - BODY // 2), BODY // 2)
    return [
        text[max(0, a - LEFT) : a].rjust(LEFT) + text[a : min(a + BODY, e)].ljust(BODY) + text[min(a + BODY, e) : min(a + BODY, e) + RIGHT].ljust(RIGHT) for a in starts
    ]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool | None, str]]:
    """(start, end, label, view), a row for each view. The label says whether a base finding covers part of a candidate; what such findings leave over
    is a candidate of its own, without a label, if it would be one alone."""
    found, k = [], 0
    for m in CANDIDATE.finditer(text):
        if not MIXED.search(m[0]):
            continue
        s, e = m.span()
        while k < len(base) and base[k][2] <= s:
            k += 1
        near = [b for b in base[k : bisect_left(base, (e,), k)] if b[2] > s]  # those that begin before the candidate's end
        found += [(s, e, bool(near), v) for v in views(text, s, e)]
        at = s
        for start, end in [(b[0], b[2]) for b in near] + [(e, e)] if near else []:
            for rest in CANDIDATE.finditer(text, at, max(at, min(start, e))):
                if MIXED.search(rest[0]):
                    found += [(*rest.span(), None, v) for v in views(text, *rest.span())]
            at = max(at, end)
    return found


def _scan(texts: list) -> tuple[list, list]:
    base = [base_findings(t or "") for t in texts]
    return (
        [[{"start": s, "kind": k, "end": e} for s, k, e in b] for b in base],
        [[{"start": s, "end": e, "hit": h, "view": v} for s, e, h, v in candidates(t or "", b)] for t, b in zip(texts, base)],
    )


BASE = "array<struct<start:long,kind:long,end:long>>"
CANDIDATES = "array<struct<start:long,end:long,hit:boolean,view:string>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (findings of the rules), cands."""
    return per_row(docs, ["doc_id"], ["text"], lambda: _scan, {"base": BASE, "cands": CANDIDATES})


_CLASS = np.full(128, 0, np.int64)
for _chars, _class in (("0123456789", 1), ("abcdef", 2), ("ghijklmnopqrstuvwxyz", 3), ("ABCDEF", 4), ("GHIJKLMNOPQRSTUVWXYZ", 5),
                       ("+/", 6), ("_-.", 7), ("=:", 8), ("\"'`", 9), (" \t\n", 10)):
    _CLASS[[ord(c) for c in _chars]] = _class


def codes(views: list[str]) -> np.ndarray:
    """Character classes, one row a view: digits, hex and other letters in either case, signs, quotes, white space, rest."""
    points = np.frombuffer("".join(views).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(views), LEFT + BODY + RIGHT)
    return np.where(points < 128, _CLASS[np.minimum(points, 127)], 11)


class CharNet:
    """One convolution over one-hot characters, tanh, maximum over positions, logistic output."""

    def __init__(self, net: Net):
        rng = np.random.default_rng(net.seed)
        self.net = net
        self.k = rng.normal(0, 0.3, (net.width, SYMBOLS, net.filters))
        self.b = np.zeros(net.filters)
        self.w = rng.normal(0, 0.3, net.filters)
        self.c = 0.0
        self.scale, self.shift, self.threshold = 1.0, 0.0, np.inf
        self.precision = 1.0

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        n = x.shape[1] - self.net.width + 1
        return np.tanh(sum(self.k[j][x[:, j : j + n]] for j in range(self.net.width)) + self.b)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = [self._hidden(x[i : i + 2048]).max(1) @ self.w + self.c for i in range(0, len(x), 2048)]
        return np.concatenate(out) if out else np.empty(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """The larger one of two views: with what stands before the candidate, and without. A secret is announced, or looks like one."""
        return self.sure(self.told(x))

    def sure(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * score + self.shift, -50, 50)))

    def step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        h = self._hidden(x)
        top = h.argmax(1)
        rows, cols = np.arange(len(x))[:, None], np.arange(self.net.filters)[None, :]
        best = h[rows, top, cols]
        error = (1 / (1 + np.exp(-np.clip(best @ self.w + self.c, -50, 50))) - y) * weight
        back = error[:, None] * self.w * (1 - best**2)
        rate = self.net.rate
        for j in range(self.net.width):
            np.add.at(self.k[j], (x[rows, top + j], np.broadcast_to(cols, top.shape)), -rate * back)
        self.b -= rate * back.sum(0)
        self.w -= rate * (error @ best)
        self.c -= rate * error.sum()

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
        """One epoch over the rows, in groups of about 64."""
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            view = x[part].copy()
            blot = rng.random(len(part)) < 0.5
            view[blot, :LEFT] = BLANK
            self.step(view, y[part], weight[part] / max(1, len(part)))

    def told(self, x: np.ndarray) -> np.ndarray:
        """The larger score of a view with what stands before the candidate and without."""
        alone = x.copy()
        alone[:, :LEFT] = BLANK
        return np.maximum(self.raw(x), self.raw(alone))

    def weights(self) -> np.ndarray:
        return np.concatenate([self.k.ravel(), self.b, self.w, [self.c]])

    def take(self, flat: np.ndarray) -> None:
        k, b, w, c = np.split(flat, np.cumsum([self.k.size, self.b.size, self.w.size]))
        self.k, self.b, self.w, self.c = k.reshape(self.k.shape), b, w, float(c[0])

    def calibrate(self, score: np.ndarray, truth: np.ndarray, n: np.ndarray) -> None:
        """Platt scaling of scores that occur ``n`` times each."""
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(self.scale * score + self.shift, -50, 50)))
            self.scale -= 0.1 * np.sum((p - truth) * score * n) / n.sum()
            self.shift -= 0.1 * np.sum((p - truth) * n) / n.sum()


def _parts(values: DataFrame, n: int, net: Net) -> DataFrame:
    """Values (hit, body, view, held) dealt by hash to parts of about ``net.part``, a row each: part, and the bytes of codes, y and held."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["hit", "order", "body"], ascending=[False, True, True])
        x = codes(rows["view"].tolist()).astype(np.uint8)
        flags = [rows[c].to_numpy(np.uint8).tobytes() for c in ("hit", "held")]
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "x": [x.tobytes()], "y": [flags[0]], "held": [flags[1]]})

    dealt = values.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "body"), F.lit(max(1, -(-n // net.part)))))
    return settle(dealt.groupBy("part").applyInPandas(pack, "part long, x binary, y binary, held binary"), "secret-parts")


def _unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(row.x, np.uint8).reshape(-1, LEFT + BODY + RIGHT).astype(np.int64)
    return x, np.frombuffer(row.y, np.uint8).astype(float), np.frombuffer(row.held, np.uint8) > 0


#: Averages of weights are taken in whole numbers of this part, so that they are the same in any order.
_FINE = 2.0**24


def _epoch(packed: DataFrame, model: CharNet, first: int, epochs: int, own: dict[bool, int]) -> None:
    """Train on every part from the same weights, and average what comes out by the rows of a part. Each task sends one row of sums."""
    shared = packed.sparkSession.sparkContext.broadcast(model)
    total = sum(own.values())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, rows = 0, 0
        for frame in frames:
            for row in frame.itertuples():
                model = copy.deepcopy(shared.value)
                x, y, held = _unpacked(row)
                x, y = x[~held], y[~held]
                weight = np.where(y == 1, 0.5 / max(1, own[True]), 0.5 / max(1, own[False])) * total
                rng = np.random.default_rng([model.net.seed, row.part, first])
                for _ in range(epochs):
                    model.train(x, y, weight, rng)
                sums, rows = sums + np.round(model.weights() * len(x) * _FINE).astype(np.int64), rows + len(x)
        if rows:
            yield pd.DataFrame({"n": [rows], "sums": [sums.tobytes()]})

    found = packed.mapInPandas(run, "n long, sums binary").collect()  # one row a task
    if found:
        model.take(sum(np.frombuffer(r["sums"], np.int64) for r in found) / _FINE / sum(r["n"] for r in found))


def fit(scanned: DataFrame, net: Net = Net()) -> CharNet:
    """Fit on every value of either kind, each value once; every third by hash is held out."""
    every = scanned.select(F.explode("cands").alias("c")).select(
        F.col("c.hit").alias("hit"), F.substring("c.view", LEFT + 1, BODY).alias("body"), "c.view"
    )
    each = every.where("hit is not null").groupBy("hit", "body").agg(F.min("view").alias("view"))
    each = settle(each.withColumn("order", F.xxhash64(F.lit(net.seed), F.col("body"))), "secret-values")
    counts = {r["hit"]: r["count"] for r in each.groupBy("hit").count().collect()}  # two rows
    model = CharNet(net)
    if min(counts.get(hit, 0) for hit in (True, False)) < 3:
        return model
    ranked = global_rank(each, ["order", "body"], group=["hit"]).withColumn("held", F.col("rank") % 3 == 0).drop("rank")
    packed = _parts(ranked, sum(counts.values()), net)
    own = {hit: n - -(-n // 3) for hit, n in counts.items()}
    # a single part has nothing to average
    rounds, epochs = (1, net.epochs) if sum(counts.values()) <= net.part else (net.epochs, 1)
    for first in range(rounds):
        _epoch(packed, model, first, epochs, own)

    shared = scanned.sparkSession.sparkContext.broadcast(model)

    def scores(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                x, y, held = _unpacked(row)
                yield pd.DataFrame({"part": row.part, "place": np.flatnonzero(held), "y": y[held], "score": shared.value.told(x[held])})

    held = settle(packed.mapInPandas(scores, "part long, place long, y double, score double"), "secret-scores")
    steps = held.groupBy("y", F.round("score", 3).alias("score")).count().orderBy("y", "score").toPandas()  # a row for each thousandth that scores reach
    model.calibrate(steps["score"].to_numpy(float), steps["y"].to_numpy(float), steps["count"].to_numpy(float))
    good = held.where("y = 1")
    place = int((1 - net.recall) * -(-counts[True] // 3))
    least = global_rank(good, ["score", "part", "place"]).where(F.col("rank") == place).first()
    if least is not None:
        model.threshold = float(model.sure(np.array([least["score"]]))[0])
        model.precision = float(held.where(F.col("score") >= least["score"]).agg(F.avg("y")).first()[0])
    return model


def findings(scanned: DataFrame, model: CharNet) -> DataFrame:
    """doc_id and the arrays start, kind, end of all findings in order, kinds by number in KINDS."""
    shared = scanned.sparkSession.sparkContext.broadcast(model)

    def compute(base: list, cands: list) -> tuple[list, ...]:
        model = shared.value
        spans = [{(b["start"], b["kind"], b["end"]) for b in found} for found in base]
        fresh = [(i, c) for i, own in enumerate(cands) for c in own if not c["hit"]]
        for at in range(0, len(fresh), 4096):
            part = fresh[at : at + 4096]
            for (i, c), p in zip(part, model.probability(codes([c["view"] for _, c in part]))):
                if p >= model.threshold:
                    spans[i].add((c["start"], 3, c["end"]))
        spans = [sorted(own) for own in spans]
        return tuple([[s[k] for s in own] for own in spans] for k in range(3))

    return per_row(scanned, ["doc_id"], ["base", "cands"], lambda: compute, dict.fromkeys(("start", "kind", "end"), "array<long>"))


def find(docs: DataFrame, net: Net = Net()) -> DataFrame:
    """Findings of every document."""
    scanned = settle(scan(docs), "secret-candidates")
    return findings(scanned, fit(scanned, net))


def redacted(docs: DataFrame, net: Net = Net()) -> DataFrame:
    """``docs`` (with doc_id, text and any other columns) with all findings in the text replaced; a column n_chars follows the text."""
    scanned = settle(scan(docs), "secret-candidates")
    shared = docs.sparkSession.sparkContext.broadcast(fit(scanned, net))

    def compute(texts: list) -> tuple[list]:
        model, out = shared.value, []
        for text in texts:
            base = base_findings(text or "")
            fresh = [c for c in candidates(text or "", base) if not c[2]]
            likely = model.probability(codes([c[3] for c in fresh])) >= model.threshold if fresh else ()
            spans = [(s, e) for s, _, e in base] + [(c[0], c[1]) for c, hit in zip(fresh, likely) if hit]
            out.append(redact(text, [s for s, _ in spans], [e for _, e in spans]) if spans else text)
        return (out,)

    out = per_row(docs, [c for c in docs.columns if c != "text"], ["text"], lambda: compute, {"text": "string"}).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the hash of the base spans, and all spans as text."""
    items = F.arrays_zip("start", "kind", "end")
    names = F.array(*[F.lit(k) for k in KINDS])

    def text(keep):
        part = F.filter("items", keep)
        return F.array_join(F.transform(part, lambda x: F.concat_ws(":", F.element_at(names, (x["kind"] + 1).cast("int")), x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("kind", lambda k: k == kind)).cast("long")

    return found.withColumn("items", items).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(text(lambda x: x["kind"] < 3), 256).alias("base_sha256"),
        text(lambda x: F.lit(True)).alias("spans"),
        count(3).alias("n_model"),
    )


def redact(text: str, start: list[int], end: list[int], mark: str = "[SECRET]") -> str:
    """The text with the union of the spans replaced."""
    out, at = [], 0
    for s, e in sorted(zip(start, end)):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def base_hash(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
