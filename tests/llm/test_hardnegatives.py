import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotvalue.llm import hardnegatives as hn
from lotvalue.llm.common import table
from lotvalue.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, k=5):
    """rows: (vec_id, vector, label) -> sorted result rows."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max((len(r[1]) for r in rows), default=0)
    x = [[math.floor(256 * float(np.float32(e))) for e in r[1]] + [0] * (width - len(r[1])) for r in rows]
    out = []
    for a, (anchor, _, label) in enumerate(rows):
        if anchor is None or anchor % every:
            continue
        s = [sum(p * q for p, q in zip(x[a], y)) for y in x]
        order = sorted((j for j in range(len(rows)) if j != a), key=lambda j: (-s[j], math.inf if rows[j][0] is None else rows[j][0]))
        for p in [j for j in order if rows[j][2] == label][:k]:
            fits = [j for j in order if rows[j][2] != label and 80 * s[p] <= 100 * s[j] <= 100 * s[p]][:k]
            out += [(anchor, rows[p][0], rank + 1, rows[j][0], s[p], s[j]) for rank, j in enumerate(fits)]
    return sorted(out, key=str)


def rows_of(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def test_equals_brute_force_in_many_blocks(spark, monkeypatch):
    for name, size in (("SHARD", 60), ("CHUNK", 3), ("ANCHORS", 2), ("ROWS", 16), ("LABELS", 3)):
        monkeypatch.setattr(hn, name, size)
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=11) + (i % 4)], i % 4) for i in range(400)]
    assert rows_of(hn.mine(spark.createDataFrame(rows, SCHEMA), every=20)) == brute(rows, 20) != []


def test_query_on_the_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in table(spark, d, "embeddings").collect()]
    assert rows_of(QUERIES["op11_hard_negatives"](spark, d)) == brute(rows) != []


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 1), (3, [0.95, 0.5], 2), (4, [0.95, 0.5], 2),
            (4, [0.95, 0.5], 3), (5, None, 1), (6, [1.0, None], 2), (7, [nan, 1.0], 2), (8, [inf, 0.1], 2), (9, [1.0, 0.5], None),
            (None, [0.95, 0.5], 2), (None, [1.0, 0.5], 1), (100, [-1.0], 1), (200, [], 2), (300, [0.0, 0.0], 4), (10, [-0.4, -0.9], 2)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("row", "planes", "shard", "chunk", "rank", "score")})
    assert rows_of(hn.mine(frame)) == brute(rows) != []
    assert hn.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hn.mine(spark.createDataFrame([(0, [1.0], 1)], SCHEMA)).count() == 0


@pytest.mark.parametrize("scale", [1, 3000, 1e9, 1e200])
def test_lookups_give_exact_products(scale):
    x = list(np.random.default_rng(2).normal(size=(30, 13)) * scale)
    scorer = hn.Scorer(13, float(max(abs(v).max() for v in x)))
    whole = hn.whole(x, 16, scorer.bits > 62)
    planes = hn.pack(whole, scorer.bits)
    got = hn.scores(hn.subset_sums(hn.unpack(planes[:4], scorer.kind)), planes)
    top = (1 << 63) - 1
    want = [[min(max(sum(int(p) * int(q) for p, q in zip(a, b)), -top), top) for b in whole] for a in whole[:4]]
    assert got.tolist() == want


def test_groups_are_bounded(spark, monkeypatch):
    """A label that holds all rows is spread over shards like any other."""
    monkeypatch.setattr(hn, "SHARD", 64)
    sizes = []
    real = hn._met

    def met(rows, anchors, keys, run, schema):
        sizes.append(rows.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return real(rows, anchors, keys, run, schema)

    monkeypatch.setattr(hn, "_met", met)
    rows = [(i, [1.0, i / 1000], 1) for i in range(1000)]
    assert hn.mine(spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert len(sizes) == 2 and sizes[0] < 450 and sizes[1] < 110
