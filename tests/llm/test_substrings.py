import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotvalue.llm import substrings
from lotvalue.llm.common import table


def brute(texts):
    """[(doc_id, bytes)] -> sorted rows of the digest."""
    starts = defaultdict(list)
    for k, (_, t) in enumerate(texts):
        for i in range(len(t) - 199):
            starts[hash(t[i:i + 200])].append((k, i))
    gone = [np.zeros(len(t), bool) for _, t in texts]
    for some in starts.values():
        if len(some) > 1:
            for k, i in some:
                gone[k][i:i + 200] = True
    out = []
    for (d, t), g in zip(texts, gone):
        rest = np.frombuffer(t, np.uint8)[~g].tobytes()
        out.append((d, len(t), int(g.sum()), int((np.diff(np.r_[0, g.astype(int)]) == 1).sum()),
                    hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def digest(frame):
    return sorted(map(tuple, frame.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("full", [20_000, 1])
def test_equals_brute_force(spark, docs, monkeypatch, full):
    monkeypatch.setattr(substrings, "FULL", full)
    monkeypatch.setattr(substrings, "PAIRS", 24 if full > 1 else 2)
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abcdé \n", k=n))                  # noqa: E731
    base = [word(n) for n in (199, 200, 205, 260, 400, 900)]
    rows = []
    for i in range(60):
        t = ""
        for _ in range(rng.randrange(1, 5)):
            b = rng.choice(base)
            a = rng.randrange(0, len(b) // 2)
            t += word(rng.randrange(0, 60)) + b[a:a + rng.randrange(100, len(b))]
        rows.append((i, t))
    rows += [(100, rows[3][1]), (101, "x" * 1000), (102, "xy" * 300), (105, "Shti " * 400), (106, "a b" + "Shti " * 150 + "tail"), (103, base[5] + base[5][:300]), (104, "x" * 199)]
    got = digest(substrings.without_repeats(docs(rows)))
    assert got == brute([(d, t.encode()) for d, t in rows])


def test_steps_and_order(monkeypatch):
    rng = random.Random(5)
    strings = list({"".join(rng.choices("ab", k=rng.randrange(0, 60))).encode() for _ in range(300)} | {b"", b"a" * 90, b"a" * 95})
    for depth in (0, 3, 24):
        monkeypatch.setattr(substrings, "SHALLOW", depth)
        got, before = substrings.deep_shallow(strings)
        assert got == sorted(strings)
        assert before == [0] + [substrings.common(a, b) for a, b in zip(got, got[1:])]
    buffer = np.frombuffer(bytes(rng.choices(range(97, 101), k=5000)), np.uint8)
    ends = np.array([700, 750, 5000])
    whole = {int(x) for a, _ in substrings.anchors(buffer, ends, substrings._powers()) for x in a}
    monkeypatch.setattr(substrings, "_STEP", 333)
    assert whole == {int(x) for a, _ in substrings.anchors(buffer, ends, substrings._powers()) for x in a}


def test_table(spark, small):
    frame = table(spark, small, "documents")
    want = brute([(r.doc_id, r.text.encode()) for r in frame.collect()])
    assert digest(substrings.without_repeats(frame)) == want
    assert sum(w[2] for w in want) > 0


def test_edges(spark, docs):
    long = "".join(random.Random(1).choices("abcdefgh ", k=300))
    rows = [(1, None), (2, ""), (None, long), (3, long), (3, long), (4, "short")]
    frame = docs(rows).withColumn("h1", F.lit(1)).withColumn("z", F.lit("x")).withColumn("gram", F.lit(1))
    got = digest(substrings.without_repeats(frame))
    assert got == brute([(d, (t or "").encode()) for d, t in rows])
    assert substrings.without_repeats(docs([])).count() == 0
