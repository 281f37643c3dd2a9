import random

import pytest
from pyspark.sql import functions as F

from lotvalue.llm import quality
from lotvalue.llm.common import table

LABELS = "doc_id long, quality int, toxic int"


def test_features_of_a_text():
    f = dict(zip(quality.FEATURES, quality.features("Ab ab|\nab ab!")))
    assert f["share_bar"] == pytest.approx(1 / 13) and f["share_mark"] == pytest.approx(1 / 13)
    assert f["word_bytes"] == 13 / 4 and f["distinct_lines"] == 1 and f["share_white"] == pytest.approx(3 / 13)
    assert quality.features(None) == quality.features(" \n") == [0.0] * len(quality.FEATURES)
    assert len(quality.features("x" * 10 ** 6)) == len(quality.FEATURES)


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    labels = table(spark, base, "labels")
    got = quality.judge(table(spark, base, "documents"), labels.where("doc_id % 3 <> 0"))
    held = got.join(labels.where("doc_id % 3 = 0"), "doc_id")
    right, n = held.agg(F.sum((F.col("keep") == (F.col("quality") == 1)).cast("int")), F.count("*")).first()
    assert n > 100 and right / n > 0.97
    assert got.count() == 1000


def test_sites_shrink(spark):
    rng = random.Random(2)
    rows = [("big", "a", 0.9 if rng.random() < 0.95 else 0.1) for _ in range(400)]
    rows += [("bad", "a", 0.1 if rng.random() < 0.95 else 0.9) for _ in range(400)]
    rows += [("big", "one", 0.1), ("tiny", "a", 0.1), (None, None, 0.9)]
    told, k = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"), 0.5)
    mean = {(r.host, r.path): (k * r.host_mean + r.s) / (k + r.n) for r in told.collect()}
    assert mean["big", "a"] > 0.8 and mean["bad", "a"] < 0.2
    assert 0.1 < mean["big", "one"] and mean["tiny", "a"] > 0.1 and mean[None, None] < 0.9
    assert k >= 1


def test_prior_decides_between_equal_texts(spark, docs):
    good, bad = "A plain sentence of words. " * 5, "x | y | z || ### $$$ " * 5
    rows = [(i, good, "en", "good") for i in range(60)] + [(100 + i, bad, "en", "bad") for i in range(60)]
    labels = spark.createDataFrame([(r[0], int(r[3] == "good"), 0) for r in rows], LABELS)
    rows += [(500, "mixed | words here. ", "en", "good"), (501, "mixed | words here. ", "en", "bad")]
    got = {r.doc_id: r for r in quality.judge(docs(rows), labels).collect()}
    assert got[500].evidence == pytest.approx(got[501].evidence)
    assert got[500].prior > got[501].prior and got[500].score > got[501].score


def test_edges(spark, docs):
    rows = [(1, "good words here. ", "en", None), (1, "good words here. ", "en", None), (None, "|| !! ||", None, "s"),
            (3, None, "en", "s"), (4, "", None, None), (5, "long " * 50000, "en", "s")]
    frame = docs(rows).withColumn("_f", F.lit(1)).withColumn("score", F.lit("x")).withColumn("f", F.lit(2))
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 0), (5, 0, 0), (3, 1, 0), (9, None, None)], LABELS)
    got = quality.judge(frame, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert all(not r.keep and r.score == 0 for r in got if r.doc_id in (3, 4))
    kept = quality.good_documents(frame, labels)
    assert kept.columns == frame.columns and kept.where("doc_id = 1").count() == 2
    none = spark.createDataFrame([], LABELS)
    assert {r.keep for r in quality.judge(docs([(1, "a b")]), none).collect()} == {True}
    assert quality.judge(docs([]), labels).count() == 0


def test_priors_equal_plain_sums_without_the_document_itself(spark, small):
    """Every posterior by plain loops; a document alone on its host has the corpus as its prior."""
    import math
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    alone = docs.limit(1).withColumns({"doc_id": F.lit(10**9).cast("long"), "source": F.lit("alone"), "text": F.lit("One page, by itself. " * 9)})
    docs = docs.unionByName(alone)
    judged = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    rows = [r for r in docs.collect() if judged[r.doc_id].score > 0]
    known = {r.doc_id: float(r.quality) for r in labels.collect() if r.quality is not None}
    of_rows = [known[r.doc_id] for r in rows if r.doc_id in known]
    base = sum(of_rows) / len(of_rows)
    p = {r.doc_id: 1 / (1 + math.exp(-(judged[r.doc_id].evidence + math.log(base / (1 - base))))) for r in rows}
    frame = spark.createDataFrame([(r.source, r.lang, p[r.doc_id]) for r in rows], "host string, path string, p double")
    told, k = quality.site_posteriors(frame, base)
    host_k = told.first().host_k
    for r in rows:
        host = [p[o.doc_id] for o in rows if o.source == r.source and o.doc_id != r.doc_id]
        path = [p[o.doc_id] for o in rows if o.source == r.source and o.lang == r.lang and o.doc_id != r.doc_id]
        mean = (host_k * base + sum(host)) / (host_k + len(host))
        assert judged[r.doc_id].prior == pytest.approx((k * mean + sum(path)) / (k + len(path)), rel=1e-6)
    assert judged[10**9].prior == pytest.approx(base, rel=1e-6)
