"""What the two vector searches share: valid vectors in shards, queries in chunks, and the merge of what shards found.

A stated query set meets all rows in blocks: every chunk of queries meets every shard of vectors in a group of bounded
size, and only the best ``k`` of each query leave it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

SHARD = 8192
CHUNK = 2048
EVERY = 20


def valid(vectors: DataFrame, component, nonzero: bool = False) -> DataFrame:
    """row (unique), vec_id, v: rows with an id and a vector of finite components, each passed through ``component``."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null").where(~bad)
    if nonzero:
        rows = rows.where(F.exists(x, lambda e: e != 0))
    rows = rows.select("vec_id", F.transform(x, component).alias("v"))
    return store(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "vectors")


def parts(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def dealt(col: str, n: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def in_blocks(index: DataFrame, rows: DataFrame, shards: int, search, schema: str) -> DataFrame:
    """index: one row or several per shard, with column shard. search(index of a shard, queries) -> rows of ``schema``."""
    asked = rows.where(F.col("vec_id") % EVERY == 0)
    chunks = parts(asked.count(), CHUNK)
    left = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = asked.withColumn("chunk", dealt("row", chunks)) \
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(queries):
            return pd.DataFrame({c.split()[0]: pd.Series(dtype="float64" if "double" in c else "int64")
                                 for c in schema.split(", ")})
        return search(own, queries.sort_values("row", ignore_index=True))

    return left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk")).applyInPandas(run, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """query_row, query_id, vec_id, score -> query_id, rank, vec_id, score; ties to the smaller vec_id."""
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def matrix(column, width: int | None = None) -> np.ndarray:
    """Rows of arrays as float64; shorter ones end in zeros."""
    width = max(map(len, column), default=0) if width is None else width
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, :min(len(v), width)] = v[:width]
    return out


class Top:
    """The best k (score, id) of several queries, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: of queries ``rows`` (lines) with vectors ``ids`` (columns); -inf where there is none."""
        floor = self.score[rows, -1]
        if scores.shape[1] > self.k:                        # of these alone no more than k and ties can stay
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        at, col = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        if not len(at):
            return
        live, at = np.unique(at, return_inverse=True)
        mine = rows[live]
        line = np.r_[np.repeat(np.arange(len(live)), self.k), at]
        score = np.r_[self.score[mine].ravel(), scores[live[at], col]]
        every = np.r_[self.id[mine].ravel(), ids[col]]
        order = np.lexsort((every, -score, line))
        first = np.searchsorted(line[order], np.arange(len(live)))
        order = order[(first[:, None] + np.arange(self.k)).ravel()].reshape(-1, self.k)
        self.score[mine], self.id[mine] = score[order], every[order]

    def rows(self, queries: pd.DataFrame, kind) -> pd.DataFrame:
        q, j = np.nonzero(self.score > -np.inf)
        return pd.DataFrame({"query_row": queries["row"].to_numpy()[q], "query_id": queries["vec_id"].to_numpy()[q],
                             "vec_id": self.id[q, j], "score": self.score[q, j].astype(kind)})
