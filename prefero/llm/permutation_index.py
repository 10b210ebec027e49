"""Approximate nearest neighbours by a permutation index.

The vectors are cut into blocks, each an index of its own.  ``PIVOTS`` vectors of a block (those whose
row numbers hash lowest) are its pivots.  Each vector is represented by its ``LISTED`` nearest pivots
in order, and posted (rank, vector) in the inverted file of each pivot that it lists.  A query
reads the files of its own pivots alone, and sums for each vector posted there
how far the shared pivots bring Spearman's footrule down from that of lists that
share none (a pivot that is not listed has rank ``LISTED``).  The share ``KEPT`` of
the block with the least footrule, ties included, is reranked by the exact inner
product in double precision.  Vectors that share no pivot with a query are not found.

Why a share and not a number: a recall of 0.9 is asked for, and on vectors without
clusters any fixed number of candidates loses it as the table grows.

Vectors that are null, zero, or hold null or non-finite components take no part.  Every other
row is indexed and is a candidate of every query of its length but its own row: rows without an
id, rows that repeat, and rows that share their id with others, whatever their vectors.  A vector of
another length has no product with a query; each length is searched by itself.  Each row that is a query has its own
ranks.  Ties in the product go to the smaller id, a null id last.  An empty table, or one without
queries, gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prefero.llm.common import small_side, staged

PIVOTS, LISTED, KEPT = 192, 48, 0.3
#: Vectors of a block and queries of a chunk, about.
BLOCK, CHUNK = 16_384, 8_192


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id long, v array<double>, n (components), row (a number): the rows that take part."""
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    whole = whole.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists("v", lambda x: x != 0))
    return whole.select("vec_id", "v", F.size("v").alias("n"), F.monotonically_increasing_id().alias("row"))


def nearest_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Numbers of each vector's nearest pivots by direction, the nearest first."""
    close = x @ pivots.T
    return np.argsort(-close, axis=1, kind="stable")[:, : min(LISTED, len(pivots))]


class InvertedFiles:
    """One file for each pivot: which vectors list it, and at what rank."""

    def __init__(self, order: np.ndarray, pivots: int) -> None:
        self.vectors, self.listed = order.shape
        by_pivot = np.argsort(order, axis=None, kind="stable")
        self.start = np.searchsorted(order.ravel()[by_pivot], np.arange(pivots + 1))
        self.vector, self.rank = np.divmod(by_pivot, self.listed)

    def gains(self, own: np.ndarray) -> np.ndarray:
        """For each vector, half of what its pivots among ``own`` (nearest first) take off the footrule; 0 if it lists none."""
        at = [slice(self.start[p], self.start[p + 1]) for p in own]
        less = [self.listed - np.maximum(self.rank[s], r) for r, s in enumerate(at)]
        return np.bincount(np.concatenate([self.vector[s] for s in at]), np.concatenate(less), self.vectors)


def exact_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component to the last, so equal vectors score equal."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * q[d]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def pivots_of(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Directions of the vectors whose row numbers hash lowest."""
    chosen = x[np.argsort(_mixed(rows), kind="stable")[:PIVOTS]]
    chosen = chosen / np.abs(chosen).max(axis=1, keepdims=True)  # keeps squares of very large and very small ones in range
    return chosen / np.linalg.norm(chosen, axis=1, keepdims=True)


def search_block(rows: np.ndarray, ids: np.ndarray, x: np.ndarray, query_rows: np.ndarray, q: np.ndarray, k: int) -> tuple[list, list, list]:
    """Query's row, place in the block and score of each query's nearest vectors; ``ids`` order ties."""
    pivots = pivots_of(rows, x)
    files, own = InvertedFiles(nearest_pivots(x, pivots), len(pivots)), nearest_pivots(q, pivots)
    keep = min(len(rows), max(4 * k, math.ceil(KEPT * len(rows))))
    out: tuple[list, list, list] = ([], [], [])
    for i, query in enumerate(query_rows):
        gains = files.gains(own[i])
        at = np.flatnonzero(gains >= max(1, np.partition(gains, len(rows) - keep)[len(rows) - keep]))
        at = at[rows[at] != query]
        if not len(at):
            continue
        close = x[at] @ q[i]
        if len(at) > k:  # what rounding could bring among the k nearest is summed exactly
            least = np.partition(close, len(at) - k)[len(at) - k]
            at = at[close >= least - 1e-9 * max(1.0, abs(least))]
        score = exact_products(x[at], q[i])
        best = np.lexsort((ids[at], -score))[:k]
        out[0].extend([query] * len(best))
        out[1].extend(at[best])
        out[2].extend(score[best])
    return out


NO_ID = np.iinfo(np.int64).max


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``is_query`` its k nearest rows found.

    Blocks of vectors meet chunks of queries of their length, so a task holds one of each whatever
    the table's size; each block gives its own k nearest, merged by query.
    """
    rows = staged(usable(vectors), "vectors")
    # as many rows as vectors have different lengths
    sizes = rows.groupBy("n").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.sum(F.when(is_query, 1).otherwise(0)) / F.lit(CHUNK))).cast("int").alias("chunks"))
    rows = rows.join(small_side(staged(sizes, "lengths")), "n")

    def search(base: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(base) or not len(asked):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="Int64"), "score": pd.Series(dtype="float64")})
        ids = base["vec_id"].astype("Int64")
        of = dict(zip(asked["q_row"], asked["q_vec_id"], strict=True))
        found = search_block(base["row"].to_numpy(), ids.fillna(NO_ID).to_numpy(np.int64), np.array(base["v"].tolist()), asked["q_row"].to_numpy(), np.array(asked["q_v"].tolist()), k)
        return pd.DataFrame({"query": np.array(found[0], np.int64), "query_id": np.array([of[r] for r in found[0]], np.int64), "vec_id": ids.array[np.array(found[1], np.int64)], "score": np.array(found[2], float)})

    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # rows are dealt by their number, so a block is of the size asked for however often an id or a vector repeats
    dealt = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "row"), F.col(n)).cast("int")
    base = rows.withColumn("block", dealt("blocks", "block")).withColumn("chunk", every("chunks")).select("n", "block", "chunk", "row", "vec_id", "v")
    asked = rows.where(is_query).withColumn("chunk", dealt("chunks", "chunk")).withColumn("block", every("blocks"))
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("n", "block", "chunk", "row", "vec_id", "v")])
    found = base.groupBy("n", "block", "chunk").cogroup(asked.groupBy("q_n", "q_block", "q_chunk")).applyInPandas(search, "query long, query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
