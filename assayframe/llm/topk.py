"""Exact top-k search by columnar branch-and-bound.

Vectors are read as integers and dealt to a grid: the queries in blocks of bounded
size, all rows in blocks of bounded size, one task a cell. A cell keeps its rows in vertical
layout, one array a dimension, and adds up the inner products dimension block by dimension block.
After each block, a row survives for a query only if its sum so far plus the largest possible rest (the
product of the remaining masses, by Cauchy and Schwarz) reaches the query's k-th best score yet; the
survivors are compacted. The best k of each cell meet in a last ranking.

Exact: sums are integers, in doubles as long as these are exact and in 64-bit integers beyond.

Defined cases: rows without an id or a vector, or with a null or non-finite component, take no
part; vectors are compared with those of their own dimension only; rows with the query's id are its own
(repeated rows count as one candidate a row); equal scores go to the smaller id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayframe.sources.session import settle


@dataclass(frozen=True)
class Search:
    """Parameters: neighbours, grid cell (queries, rows), dimensions a block, rows compared before the first bound."""

    k: int = 5
    query_block: int = 4_096
    row_block: int = 16_384
    dims: int = 16
    first: int = 512


def whole_vectors(table: DataFrame) -> DataFrame:
    """vec_id, v (whole numbers), of the rows that take part."""
    clean = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    return table.where(F.col("vec_id").isNotNull() & F.coalesce(clean, F.lit(False))).select("vec_id", v.alias("v"))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= cut
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class Columns:
    """Rows of a cell in vertical layout, with the mass of the dimensions that are still to come."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, search: Search):
        self.ids, self.search = ids, search
        self.columns = np.ascontiguousarray(rows.T)
        self.starts = list(range(0, rows.shape[1], search.dims))
        square = np.ascontiguousarray(rows.T.astype(np.float64)) ** 2
        self.mass = [np.sqrt(square[s:].sum(0)) for s in self.starts] + [np.zeros(len(ids))]

    def nearest(self, query_id: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, first = self.search.k, self.search.first
        other = np.flatnonzero(self.ids != query_id)
        head, tail = other[:first], other[first:]
        ids, scores = best(self.ids[head], query @ self.columns[:, head], k)
        if not len(tail):
            return ids, scores
        floor = scores[-1] if len(scores) == k else None
        rest = np.sqrt([float((query[s:].astype(np.float64) ** 2).sum()) for s in self.starts] + [0.0])
        part = np.zeros(len(tail), self.columns.dtype)
        for i, s in enumerate(self.starts):
            block = slice(s, s + self.search.dims)
            part = part + query[block] @ self.columns[block][:, tail]
            if floor is not None:
                # a little more than the bound, for the rounding of its own arithmetic
                alive = part + (rest[i + 1] * self.mass[i + 1][tail] * (1 + 1e-9) + 1) >= floor
                tail, part = tail[alive], part[alive]
        return best(np.concatenate((ids, self.ids[tail])), np.concatenate((scores, part)), k)


def _cell(search: Search):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows) and len(rows["v"].iloc[0]):
            q, x = np.stack(queries["v"].to_numpy()), np.stack(rows["v"].to_numpy())
            exact = float(np.abs(q.astype(float)).max()) * float(np.abs(x.astype(float)).max()) * q.shape[1] < 2**52
            kind = np.float64 if exact else np.int64
            columns = Columns(rows["vec_id"].to_numpy(), x.astype(kind), search)
            for ask, query_id, query in zip(queries["ask"], queries["vec_id"], q.astype(kind)):
                ids, scores = columns.nearest(query_id, query)
                out.append(pd.DataFrame({"ask": ask, "query_id": query_id, "vec_id": ids, "score": scores.astype(np.int64)}))
        elif len(queries) and len(rows):  # vectors of no dimension: every score is 0
            for ask, query_id in zip(queries["ask"], queries["vec_id"]):
                ids = np.sort(rows["vec_id"].to_numpy()[rows["vec_id"].to_numpy() != query_id])[: search.k]
                out.append(pd.DataFrame({"ask": ask, "query_id": query_id, "vec_id": ids, "score": np.zeros(len(ids), np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"ask": [], "query_id": [], "vec_id": [], "score": []}, dtype=np.int64)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, search: Search = Search()) -> DataFrame:
    """query_id, rank, vec_id, score: the best rows of ``vectors`` for each of ``queries`` (both vec_id, v). Every row of ``queries`` asks for itself,
    so a repeated id has as many answers as rows."""
    queries = settle(queries.select("vec_id", "v", F.monotonically_increasing_id().alias("ask")), "topk-queries")
    vectors = vectors.select("vec_id", "v", F.lit(0).cast("long").alias("ask"))
    n_rows, n_queries = vectors.count(), queries.count()
    row_blocks, query_blocks = -(-max(1, n_rows) // search.row_block), -(-max(1, n_queries) // search.query_block)

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        mine = F.pmod(F.xxhash64(F.lit(own), F.col("vec_id")), F.lit(n_own)).cast("int")
        return df.select("ask", "vec_id", "v", F.size("v").alias("dim"), mine.alias(own), F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

    asked = dealt(queries, "query_block", query_blocks, "row_block", row_blocks).groupBy("dim", "query_block", "row_block")
    there = dealt(vectors, "row_block", row_blocks, "query_block", query_blocks).groupBy("dim", "query_block", "row_block")
    found = asked.cogroup(there).applyInPandas(_cell(search), "ask long, query_id long, vec_id long, score long")
    order = Window.partitionBy("ask").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= search.k).select("query_id", "rank", "vec_id", "score")


def every_fiftieth(table: DataFrame) -> DataFrame:
    vectors = settle(whole_vectors(table), "topk-vectors")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


SQL = """
WITH v AS (SELECT row_number() OVER () AS ask, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.ask, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
