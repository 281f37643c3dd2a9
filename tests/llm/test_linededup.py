import random

import pytest
from pyspark.sql import functions as F

from lotvalue.llm import linededup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        after = [i + 1]
        for j, y in enumerate(b):
            after.append(min(row[j + 1] + 1, after[-1] + 1, row[j] + (x != y)))
        row = after
    return row[-1]


def edited(rng, b, most=4):
    a = list(b)
    for _ in range(rng.randrange(0, most + 1)):
        kind, i = rng.randrange(3), rng.randrange(len(a) + 1)
        if kind == 0:
            a.insert(i, rng.choice("abé"))
        elif a:
            i = min(i, len(a) - 1)
            a[i:i + 1] = [] if kind == 1 else [rng.choice("abé")]
    return "".join(a)


def brute(rows):
    """(doc_id, text) -> doc_id -> (n_lines, n_removed, n_links, text)."""
    lines = [(d, i, x.encode()) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))]
    first = {}
    for d, i, x in sorted(lines):
        if len(x) >= 32:
            first.setdefault(x, (d, i))
    near = {x: [y for y in first if y != x and distance(x, y) <= 2] for x in first}
    out = {}
    for d, t in rows:
        own = [] if t is None else [(i, x) for e, i, x in lines if e == d]
        stay = [x for i, x in own if x not in first or (first[x] == (d, i) and all(first[y] > (d, i) for y in near[x]))]
        links = sum(len(near.get(x, ())) for _, x in own)
        out[d] = (len(own), len(own) - len(stay), links, None if t is None else b"\n".join(stay).decode())
    return out


def test_band_equals_edit_distance(spark):
    rng, rows = random.Random(1), []
    for _ in range(1500):
        b = "".join(rng.choices("ab", k=rng.randrange(0, 40)))
        a, b = sorted((edited(rng, b, 5), b), key=lambda x: -len(x.encode()))
        if len(a.encode()) - len(b.encode()) <= 2:
            rows.append((a, b, distance(a.encode(), b.encode()) <= 2))
    got = spark.createDataFrame(rows, "a string, b string, ok boolean") \
        .select("ok", linededup.within(F.col("a").cast("binary"), F.col("b").cast("binary")).alias("got"))
    assert got.where("ok <> got or got is null").count() == 0
    assert got.where("ok").count() > 100


@pytest.mark.parametrize("hot", [16, 1])
def test_equals_brute_force(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(linededup, "HOT", hot)
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdefé ", k=rng.choice([31, 32, 33, 40, 70]))) for _ in range(12)]
    rows = [(d, "\n".join(edited(rng, rng.choice(base), 3) for _ in range(rng.randrange(1, 7)))) for d in range(40)]
    rows += [(100, rows[3][1]), (101, "x" * 200 + "\n" + "x" * 201 + "\n" + "x" * 203), (102, "short\nshort")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_links, r.text) for r in linededup.dedup_lines(docs(rows)).collect()}
    want = brute(rows)
    assert got == want
    assert sum(w[2] for w in want.values()) > 50


def test_edges(spark, docs):
    line = "a line that is long enough to be compared"
    rows = [(5, None), (6, ""), (None, line), (2, line + "\n\n" + line), (1, line[:-1]), (9, "z" * 70000), (10, "z" * 70000)]
    frame = docs(rows).withColumn("row", F.lit(3)).withColumn("gone", F.lit("g")).withColumn("id", F.lit(1))
    got = {r.doc_id: r for r in linededup.dedup_lines(frame).collect()}
    assert len(got) == 7
    assert got[5].text is None and got[5].n_lines == 0 and got[6].text == ""
    assert got[1].text == line[:-1] and got[2].text == "" and got[2].n_removed == 2 and got[None].text == ""
    assert got[9].n_removed == 0 and got[10].n_removed == 1
    out = linededup.without_repeats(frame)
    assert out.columns == frame.columns and out.count() == 7
    assert {r.doc_id: r.n_chars for r in out.collect()}[2] == 0
    assert linededup.dedup_lines(docs([])).count() == 0
    twice = linededup.dedup_lines(docs([(1, line), (1, line)])).collect()
    assert [r.text for r in twice] == [line, line]
