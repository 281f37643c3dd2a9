import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotvalue.llm import collisions, mtree, vectors
from lotvalue.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, whole, k=20):
    """rows: (vec_id, vector) -> (query_id, rank) -> (vec_id, score)."""
    rows = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([v for _, v in rows], np.float64)
    x = np.floor(64 * x) if whole else x
    ids, out = np.array([i for i, _ in rows]), {}
    for at in np.flatnonzero(ids % 20 == 0):
        s = x @ x[at]
        order = [j for j in np.lexsort((ids, -s)) if j != at][:k]
        out |= {(int(ids[at]), r + 1): (int(ids[j]), s[j]) for r, j in enumerate(order)}
    return out


def test_exact_on_the_table(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SHARD", 150)                         # several shards, several chunks
    monkeypatch.setattr(mtree, "PAGE", 16)
    monkeypatch.setattr(vectors, "CHUNK", 10)
    frame = table(spark, "/root/testdata/sf0.01", "embeddings")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in mtree.top_k(frame).collect()}
    assert got == brute([(r.vec_id, r.embedding) for r in frame.collect()], True)


def test_bounds_save_products():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 40
    x = np.floor(centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 8)))
    import pandas as pd
    rows = pd.DataFrame({"shard": 0, "row": range(3000), "vec_id": range(3000), "v": list(x)})
    top = float((x * x).sum(axis=1).max())
    found, computed = mtree.search(mtree.build(rows, top, 8), rows[:100], top, 8, 5)
    s = x[:100] @ x.T
    s[np.arange(100), np.arange(100)] = -np.inf
    want = np.stack([np.lexsort((np.arange(3000), -r))[:5] for r in s])
    assert (found.id == want).all()
    assert computed < 0.5 * 100 * 3000


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.5], 0) for i in range(60)]
    got = mtree.top_k(spark.createDataFrame(rows, SCHEMA)).where("query_id = 20").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20)) and {r.score for r in got} == {64 * 64 + 32 * 32}


@pytest.mark.parametrize("search", [mtree.top_k, collisions.nearest])
def test_edges(spark, search):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (20, [0.5, -0.5], 1), (1, [0.25, 1.0], 1), (2, None, 1), (3, [1.0, None], 1), (4, [nan, 1.0], 1),
            (5, [inf, 1.0], 1), (None, [1.0, 1.0], 1), (7, [-0.3, 0.9], 1), (7, [-0.3, 0.9], 1)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("x")).withColumn("v", F.lit(1)) \
        .withColumn("rank", F.lit(0))
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in search(frame).collect())
    assert [g[2] for g in got if g[0] == 0] == [20, 1, 7, 7] and [g[2] for g in got if g[0] == 20] == [0, 1, 7, 7]
    assert len(got) == 8
    assert search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert search(spark.createDataFrame([(40, [1.0], 0)], SCHEMA)).count() == 0


def test_zero_vectors(spark):
    rows = [(0, [0.0, 0.0], 1), (20, [0.5, -0.5], 1), (1, [0.25, 1.0], 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert {(r.query_id, r.vec_id) for r in collisions.nearest(frame).collect()} == {(20, 1)}
    assert mtree.top_k(frame).where("query_id = 0").count() == 2


def test_recall_of_collisions(spark):
    frame = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    want = brute(rows, False)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in collisions.nearest(frame).collect()}
    assert got.keys() == want.keys()
    hit = {(q, v) for (q, _), (v, _) in got.items()} & {(q, v) for (q, _), (v, _) in want.items()}
    assert len(hit) / len(want) >= 0.9
    x = dict((i, np.array(v, np.float64)) for i, v in rows)
    for (q, _), (v, s) in got.items():
        assert s == pytest.approx(float(x[q] @ x[v]), abs=1e-12)
