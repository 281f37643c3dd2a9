"""Approximate nearest neighbours by collision counting over query-centred windows.

Each of ``PROJECTIONS`` random directions gives a sorted array of all vectors of a shard. A query's window in it is centred at the
query's own projection; a vector in the windows of at least ``ENOUGH`` of the directions has enough collisions and is verified
by its exact product. Virtual rehashing widens all windows by ``GROW`` at a time, and verifies only what is new, until the k-th best
found is within the radius that the windows stand for, or all vectors are verified. Nothing is cut off: windows grow until
that condition holds. Products become distances by one more component, as every vector is brought to the
largest norm.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store
from .vectors import SHARD, Top, best, dealt, in_blocks, matrix, parts, valid

PROJECTIONS = 64
ENOUGH = 43
GROW = 1.15
#: Half a window is so many times the radius.
WIDTH = 0.95
#: The first radius, and the share of the radius that ends a search, in units of the largest norm.
START = 0.6
STOP = 0.88
K = 20
#: Queries whose counts are held at once.
TILE = 128
INDEX = "shard int, rows array<long>, ids array<long>, vectors array<double>, places array<int>, values array<double>"


def _directions(width: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((width + 1, PROJECTIONS))


def build(pdf: pd.DataFrame, norm: float, width: int) -> pd.DataFrame:
    """The sorted arrays of one shard (shard, row, vec_id, v), in units of the largest norm."""
    pdf = pdf.sort_values("row", ignore_index=True)
    x = matrix(pdf["v"], width)
    lifted = np.c_[x / norm, np.sqrt(np.maximum(1 - (x * x).sum(axis=1) / norm ** 2, 0))]
    at = lifted @ _directions(width)
    order = np.argsort(at, axis=0, kind="stable")
    return pd.DataFrame([(int(pdf["shard"].iat[0]), pdf["row"].to_numpy(), pdf["vec_id"].to_numpy(), x.ravel(),
                          order.T.astype(np.int32).ravel(), np.take_along_axis(at, order, axis=0).T.ravel())],
                        columns=[c.split()[0] for c in INDEX.split(", ")])


def search(index: pd.DataFrame, queries: pd.DataFrame, width: int, k: int) -> tuple[Top, int]:
    """The best ``k`` found in one shard for each query, and how many vectors were verified."""
    one = index.iloc[0]
    ids, rows = np.asarray(one["ids"]), np.asarray(one["rows"])
    x = np.asarray(one["vectors"]).reshape(len(ids), width)
    order = np.asarray(one["places"]).reshape(PROJECTIONS, len(ids))
    values = np.asarray(one["values"]).reshape(PROJECTIONS, len(ids))
    own, v = queries["row"].to_numpy(), matrix(queries["v"], width)
    length = np.linalg.norm(v, axis=1)
    norm = float(index["norm"].iat[0])
    centre = (v / length[:, None]) @ _directions(width)[:-1]
    place = np.empty((PROJECTIONS, len(ids)), np.uint16)    # where a vector stands in each sorted array
    np.put_along_axis(place, order, np.arange(len(ids), dtype=np.uint16)[None, :], axis=1)
    found, checked = Top(len(v), k), 0
    for s in range(0, len(v), TILE):
        live, radius = np.arange(s, min(s + TILE, len(v))), START
        verified = np.zeros((len(live), len(ids)), bool)
        while len(live):
            half, hits, whole = WIDTH * radius, np.zeros((len(live), len(ids)), np.uint8), np.ones(len(live), bool)
            for j in range(PROJECTIONS):
                a = np.searchsorted(values[j], centre[live, j] - half, side="left").astype(np.uint16)
                b = np.searchsorted(values[j], centre[live, j] + half, side="right").astype(np.uint16)
                hits += (place[j] - a[:, None]) < (b - a)[:, None]          # unsigned: below a wraps around
                whole &= b - a == len(ids)
            fresh = (hits >= ENOUGH) & ~verified[live - s]
            used = np.flatnonzero(fresh.any(axis=0))
            if len(used):
                score = v[live] @ x[used].T
                found.add(live, np.where(fresh[:, used] & (rows[used] != own[live, None]), score, -np.inf), ids[used])
                verified[live - s] |= fresh
                checked += int(fresh.sum())
            # The distance of the k-th best in units of the largest norm: 2 - 2 cos, as all vectors have that norm.
            far = np.sqrt(np.maximum(2 - 2 * found.score[live, -1] / (length[live] * norm), 0))
            live = live[~((far <= STOP * radius) | whole)]
            radius *= GROW
    return found, checked


def nearest(vectors: DataFrame, k: int = K) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score (inner product, double).

    Queries are the rows whose vec_id is divisible by 20; candidates are all rows but the query's own. Rows with a null id,
    and vectors null, zero or with a null or non-finite component, take no part; shorter vectors count as ending in zeros. A
    repeated vec_id is a row of its own. An empty table, or one without a query, gives no rows. Other columns are ignored.
    """
    rows = valid(vectors, lambda e: e.cast("double"), nonzero=True)
    n, norm, width = rows.agg(F.count("*"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))),
                              F.max(F.size("v"))).first()
    norm, width, shards = norm or 1.0, width or 0, parts(n, SHARD)
    index = store(rows.withColumn("shard", dealt("row", shards)).groupBy("shard")
                  .applyInPandas(lambda pdf: build(pdf, norm, width), INDEX), "projections").withColumn("norm", F.lit(norm))
    found = in_blocks(index, rows, shards, lambda p, q: search(p, q, width, k)[0].rows(q, np.float64),
                      "query_row long, query_id long, vec_id long, score double")
    return best(found, k)
