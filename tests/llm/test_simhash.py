import random

import pytest
from pyspark.sql import functions as F

from lotvalue.llm import simhash
from lotvalue.llm.common import table


def brute(rows):
    """rows: (doc_id, fp) -> doc_id -> smallest doc_id reachable."""
    group = {fp: fp for _, fp in rows}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x
    fps = sorted(group)
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 3:
                group[find(b)] = find(a)
    least = {}
    for d, fp in rows:
        least[find(fp)] = min(d, least.get(find(fp), d))
    return {d: least[find(fp)] for d, fp in rows}


def test_fingerprint_follows_spark_hash(spark):
    rows = [r.h & (2 ** 64 - 1) for r in spark.sql(
        "select xxhash64(s) h from values ('a b c'), ('b c é') as t(s)").collect()]
    assert simhash.fingerprint("A  b\tC") & (2 ** 64 - 1) == rows[0]
    assert simhash.fingerprint("a b C é") & (2 ** 64 - 1) == rows[0] & rows[1]
    assert simhash.fingerprint("É") != simhash.fingerprint("é")      # only A-Z are lower-cased
    assert simhash.fingerprint("a b") != simhash.fingerprint("a b")


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = " ".join(random.Random(1).choices("abcdefgh", k=1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_MOST_AT_ONCE", 7)
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("group", [256, 4])
def test_links_equal_brute_force(spark, monkeypatch, group):
    rng = random.Random(group)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = [0]
    for b in base:
        for _ in range(12):
            x = b
            for bit in rng.sample(range(64), rng.choice([0, 1, 2, 3, 5])):
                x ^= 1 << bit
            fps.append(x)
    for _ in range(40):                                   # many variants of one centre
        fps.append(base[0] ^ (1 << rng.randrange(64)))
    rows = [(i, simhash._signed(f)) for i, f in enumerate(fps)]
    monkeypatch.setattr(simhash, "GROUP", group)
    got = {r.doc_id: r.component_id for r in
           simhash._assigned(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    assert got == brute(rows)


def test_documents_equal_brute_force(spark, small):
    docs = table(spark, small, "documents")
    got = simhash.near_duplicates(docs).collect()
    rows = [(r.doc_id, simhash.fingerprint(r.text)) for r in docs.collect()]
    assert {r.doc_id: r.component_id for r in got} == brute(rows)
    assert {(r.doc_id, r.fingerprint) for r in got} == {(d, f"{f & (2 ** 64 - 1):016x}") for d, f in rows}
    assert len(got) == len(rows)


def test_edges(spark, docs):
    rows = [(5, None), (4, ""), (None, " \t"), (3, "one two three four"), (2, "ONE two three four"), (2, "ONE two three four")]
    frame = docs(rows).withColumn("fingerprint", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = sorted(map(tuple, simhash.near_duplicates(frame).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(5, 4), (4, 4), (None, 4), (3, 2), (2, 2), (2, 2)], key=str)
    assert simhash.near_duplicates(docs([])).count() == 0
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4]
