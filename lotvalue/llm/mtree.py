"""Exact top-k by inner product with M-trees.

Inner products become distances by one more component: with M the largest norm of all vectors, x gets sqrt(M^2 - |x|^2)
and a query gets 0, so d(q, x)^2 = |q|^2 + M^2 - 2 q.x and the nearest vector has the largest product. Each shard of vectors is an
M-tree of pages: leaf pages of vectors, inner pages of leaf pages. A page has a pivot, a covering radius
and its distance to its parent's pivot; a vector has its distance to its page's pivot. A search visits, query by query, the
page with the least possible distance next (best first) and stops when that is above the k-th best found. Before a
distance is computed, the triangle inequality over stored parent distances may rule it out. Scores are exact: products of whole numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store
from .vectors import SHARD, Top, best, dealt, in_blocks, matrix, parts, valid

PAGE = 256
K = 20
PAGES = ("shard int, page int, parent int, level int, radius double, to_parent double, pivot array<double>, "
         "ids array<long>, rows array<long>, entry_distance array<double>, vectors array<double>")


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    """With the component that gives every vector the norm sqrt(top)."""
    return np.c_[x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))]


def _split(x: np.ndarray, size: int, seed: int) -> list[np.ndarray]:
    """Members of groups of ``size`` at most: nearest of pivots that lie far apart, again until small enough."""
    done, todo, rng = [], [np.arange(len(x))], np.random.default_rng(seed)
    while todo:
        own = todo.pop()
        if len(own) <= size:
            done.append(own)
            continue
        want = int(min(16, -(-len(own) // size) + 1))
        sample = own[rng.permutation(len(own))[:64 * want]]
        picked = [sample[0]]
        far = np.linalg.norm(x[sample] - x[sample[0]], axis=1)
        while len(picked) < want and far.max() > 0:
            picked.append(sample[far.argmax()])
            far = np.minimum(far, np.linalg.norm(x[sample] - x[picked[-1]], axis=1))
        y = x[own]
        near = ((y * y).sum(axis=1)[:, None] - 2 * y @ x[picked].T + (x[picked] ** 2).sum(axis=1)).argmin(axis=1)
        groups = [own[near == g] for g in range(len(picked))]
        if max(map(len, groups)) == len(own):               # all alike
            groups = np.array_split(own, -(-len(own) // size))
        todo += [g for g in groups if len(g)]
    return done


def build(pdf: pd.DataFrame, top: float, width: int) -> pd.DataFrame:
    """The pages of one shard (shard, row, vec_id, v)."""
    pdf = pdf.sort_values("row", ignore_index=True)
    x = matrix(pdf["v"], width)
    y = _lifted(x, top)
    out, leaves = [], _split(y, PAGE, 1)
    pivots = np.stack([y[g].mean(axis=0) for g in leaves])
    pivots = np.stack([y[g][np.linalg.norm(y[g] - c, axis=1).argmin()] for g, c in zip(leaves, pivots)])
    inner = _split(pivots, max(4, int(np.sqrt(len(leaves)))), 2)
    shard = int(pdf["shard"].iat[0])
    for i, group in enumerate(inner):
        centre = pivots[group][np.linalg.norm(pivots[group] - pivots[group].mean(axis=0), axis=1).argmin()]
        members = np.concatenate([leaves[g] for g in group])
        out.append((shard, i, -1, 1, np.linalg.norm(y[members] - centre, axis=1).max(), 0.0, centre, [], [], [], []))
        for g in group:
            own = leaves[g]
            far = np.linalg.norm(y[own] - pivots[g], axis=1)
            out.append((shard, int(g), i, 0, far.max(), float(np.linalg.norm(pivots[g] - centre)), pivots[g],
                        pdf["vec_id"].to_numpy()[own], pdf["row"].to_numpy()[own], far, x[own].ravel()))
    return pd.DataFrame(out, columns=[c.split()[0] for c in PAGES.split(", ")])


def search(pages: pd.DataFrame, queries: pd.DataFrame, top: float, width: int, k: int) -> tuple[Top, int]:
    """The best ``k`` of one shard for each query, and how many products were computed."""
    q = matrix(queries["v"], width)
    qq, own = (q * q).sum(axis=1), queries["row"].to_numpy()
    slack = 1e-7 * (1 + np.sqrt(qq + top))
    inner = pages[pages["level"] == 1].sort_values("page")
    leaf = pages[pages["level"] == 0].sort_values("page")

    def pivots(of):
        return np.stack(of["pivot"].to_numpy())[:, :width]

    def distance(queries_at, p):                            # the last component of a query is 0
        return np.sqrt(np.maximum(qq[queries_at, None] + top - 2 * q[queries_at] @ p.T, 0))

    found, computed, all_q = Top(len(q), k), 0, np.arange(len(q))
    to_inner = distance(all_q, pivots(inner))
    parent, to_parent, radius = (leaf[c].to_numpy() for c in ("parent", "to_parent", "radius"))
    leaf_pivots = pivots(leaf)
    entries = [(r, i, e, np.asarray(v).reshape(-1, width)) for r, i, e, v in
               zip(leaf["rows"], leaf["ids"], leaf["entry_distance"], leaf["vectors"])]
    reach = np.full(len(q), np.inf)                         # no vector farther than this can be among the best
    to_leaf = np.full((len(q), len(leaf)), np.nan)
    open_ = np.maximum(to_inner - inner["radius"].to_numpy(), 0)[:, parent]
    open_ = np.maximum(open_, np.abs(to_inner[:, parent] - to_parent) - radius)     # without any leaf pivot

    def visit(rows, at):
        nonlocal computed
        ids_row, ids, far, v = entries[at]
        d = to_leaf[rows, at]
        need = (np.abs(d[:, None] - far) <= reach[rows, None]).any(axis=0)          # stored distances first
        if need.any():
            s = q[rows] @ v[need].T
            computed += s.size
            s[own[rows, None] == ids_row[need]] = -np.inf
            found.add(rows, s, ids[need])
        kth = found.score[rows, -1]
        reach[rows] = np.where(kth > -np.inf, np.sqrt(np.maximum(qq[rows] + top - 2 * kth, 0)) + slack[rows], np.inf)

    while True:
        at = open_.argmin(axis=1)
        rows = np.flatnonzero(open_[all_q, at] <= reach)
        rows = rows[open_[rows, at[rows]] < np.inf]
        if not len(rows):
            return found, computed
        order = rows[np.argsort(at[rows], kind="stable")]
        for some in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            page = at[some[0]]
            fresh = some[np.isnan(to_leaf[some, page])]
            if len(fresh):                                  # first its distance; it may move back in the queue
                to_leaf[fresh, page] = distance(fresh, leaf_pivots[page:page + 1])[:, 0]
                open_[fresh, page] = np.maximum(open_[fresh, page], to_leaf[fresh, page] - radius[page])
            ready = some[open_[some, page] <= np.minimum(reach[some], open_[some].min(axis=1))]
            if len(ready):
                visit(ready, page)
                open_[ready, page] = np.inf


def top_k(vectors: DataFrame, k: int = K) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by 20; candidates are all rows but the query's own. Components become floor(64 x).
    Rows with a null id, and vectors null or with a null or non-finite component, take no part; shorter vectors
    count as ending in zeros. A repeated vec_id is a row of its own, as query and as candidate. An empty table, or one
    without a query, gives no rows. Products are summed as doubles: scores beyond 2^53 are not exact. Other columns are ignored.
    """
    rows = valid(vectors, lambda e: F.floor(e.cast("double") * 64).cast("double"))
    n, top, width = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)),
                             F.max(F.size("v"))).first()
    top, width = top or 0.0, width or 0
    shards = parts(n, SHARD)
    pages = store(rows.withColumn("shard", dealt("row", shards)).groupBy("shard")
                  .applyInPandas(lambda pdf: build(pdf, top, width), PAGES), "metric_pages")
    found = in_blocks(pages, rows, shards, lambda p, q: search(p, q, top, width, k)[0].rows(q, np.int64),
                      "query_row long, query_id long, vec_id long, score long")
    return best(found, k)
