import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lotvalue.llm import mixing
from lotvalue.llm.common import table


def targets(sizes):
    """{source: size} -> {source: target}, by sharing again and again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3 * sizes[s] for s in capped}
        capped |= over


def test_targets_and_taken_words(spark, small):
    docs = table(spark, small, "documents")
    got = mixing.mix(docs).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    want = {r.doc_id: len(re.findall(rb"[^\x20\x09-\x0D]+", r.text.encode())) for r in docs.collect()}
    sizes = Counter()
    for d, n in want.items():
        sizes[source[d]] += n
    expected, taken, largest = targets(sizes), Counter(), Counter()
    assert {r.doc_id: r["size"] for r in got} == want
    for r in got:
        s = source[r.doc_id]
        assert r.target == pytest.approx(expected[s]) and r.source_size == sizes[s]
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= largest[s]
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_reduction_tree(spark, docs, monkeypatch):
    rows = [(i, "w " * (1 + i % 7), "en", "a" if i % 3 else f"s{i % 4}") for i in range(600)]
    monkeypatch.setattr(mixing, "FAN", 8)                            # three levels
    got = mixing.mix(docs(rows)).collect()
    assert len(got) == 600
    taken, target = Counter(), {}
    for r in got:
        s = rows[r.doc_id][3]
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken in {k * r["size"] for k in range(4)}
    assert all(abs(taken[s] - target[s]) <= 8 for s in target)      # mass is kept: rounded at the root only


def test_edges(spark, docs):
    rows = [(1, None, "en", None), (2, "", "en", "b"), (None, "x y", "en", None), (4, "a b c", "en", "a"),
            (4, "a b c", "en", "a"), (5, "\x0b\x1cz", "en", "c")]
    frame = docs(rows).withColumn("size", F.lit(9)).withColumn("target", F.lit("t"))
    got = mixing.mix(frame).collect()
    assert len(got) == 6 and sorted(r["size"] for r in got) == [0, 0, 1, 2, 3, 3]
    assert sum({r.source_size: r.target for r in got}.values()) == pytest.approx(9)
    assert mixing.mix(docs([])).count() == 0
    out = mixing.mixed(frame)
    assert out.columns == frame.columns and out.where("text is null or text = ''").count() == 0
    assert mixing.mix(docs([(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0


def test_mixed_rows_follow_copies(spark, small):
    docs = table(spark, small, "documents")
    want = {r.doc_id: r.copies for r in mixing.copies(mixing._sized(docs, mixing.row_hash(docs).alias("row")))[0].collect()}
    got = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert got == Counter({k: v for k, v in want.items() if v})


def test_accuracy_of_a_source_depends_on_its_own_rows(spark, docs, monkeypatch):
    # Rows of 1 to 100 words; the largest are the last to be rounded. The other source is small or large.
    size = lambda i: 1 + i * 37 % 100                                               # noqa: E731
    small = [(i, "w " * size(i), "en", "b") for i in range(100)]
    monkeypatch.setattr(mixing, "FAN", 128)
    for n in (90, 1500):
        rows = small + [(1000 + i, "w " * size(i), "en", "a") for i in range(n)]
        got = mixing.mix(docs(rows)).collect()
        assert len(got) == len(rows)
        for name in ("a", "b"):
            own = [r for r in got if (r.doc_id < 1000) == (name == "b")]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 2, (n, name)
