from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotvalue.llm import langid
from lotvalue.llm.common import table


def test_filter_equals_sets(spark, docs):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(
        [("the cat sat on the mat " * 4, "en"), ("der hund und die katze " * 4, "de"), ("le chat est là " * 4, "fr")])]
    model = langid.learn(docs(rows).select("text", "lang"))
    assert model.languages == ["de", "en", "fr"]
    seen = {}
    for _, t, lang in rows:
        raw = langid.letters(t)
        grams = [raw[i:i + 3] for i in range(len(raw) - 2) if raw[i + 1] != 32]
        for g in set(grams):
            seen.setdefault(g, {})[lang] = grams.count(g) / len(grams) if grams.count(g) >= 3 else 0
    for g, rates in seen.items():
        got = int(model.look_up(np.array([int.from_bytes(g)], np.uint32))[0, 0])
        want = sum(1 << model.languages.index(x) for x, r in rates.items() if r and r >= 0.25 * max(rates.values()))
        assert got & want == want
    n, hits = model.tally(["the", None, "là"])
    assert n.tolist() == [3, 0, 3] and hits[0, 1] == 3 and hits[2, 2] == 3


def test_texts_in_steps(monkeypatch):
    masks = np.random.default_rng(1).integers(0, 8, (langid.SLOTS, 1)).astype(np.uint64)
    model = langid.Filter(["a", "b", "c"], masks)
    texts = ["some words here", "", None, "x" * 500, "é è", "last"]
    whole = model.tally(texts)
    monkeypatch.setattr(langid, "_STEP", 7)
    assert all((a == b).all() for a, b in zip(whole, model.tally(texts)))


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.identify(docs)
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 150 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_prediction_uses_text_alone(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    key = ["doc_id", "lang_pred", "score"]
    changed = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang"))) \
        .withColumn("source", F.lit(None).cast("string"))
    assert sorted(map(tuple, langid.identify(docs).select(key).collect())) == \
        sorted(map(tuple, langid.identify(changed).select(key).collect()))


def test_edges(spark, docs):
    rows = [(1, None, "en"), (None, "words", "en"), (3, "", None), (4, "12 !? 3", "en"), (5, "hello there " * 9, "en"),
            (5, "hello there " * 9, "en"), (6, "bonjour à tous " * 9, "fr"), (7, "hello " * 300000, None), (8, "日本", None)]
    rows = [(d if d is None or crc32(str(d).encode()) % 4 != 2 else d + 100, t, x) for d, t, x in rows]
    frame = docs(rows).withColumn("score", F.lit("x")).withColumn("held_out", F.lit(1))
    got = langid.identify(frame).collect()
    assert len(got) == len(rows)
    assert {r.lang_pred for r in got if r.score == 0} >= {"und"} and {r.lang_pred for r in got} >= {"en", "fr", "und"}
    assert [r.lang_pred for r in got if r.doc_id in (7, 107)] == ["en"]
    assert langid.identify(docs([])).count() == 0
    assert {r.lang_pred for r in langid.identify(docs([(1, "abc")])).collect()} == {"und"}
