import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lotvalue.llm import linededup, mixing, packing, quality, simhash
from lotvalue.llm.common import store, table

from .test_linededup import distance

from .test_simhash import brute as groups


def without_lines(rows):
    """[(doc_id, text)] -> {doc_id: text} without later equal or nearly equal lines, compared one by one."""
    lines = [(d, i, x.encode()) for d, t in sorted(rows) for i, x in enumerate(t.split("\n"))]
    first, later = {}, set()
    for d, i, x in lines:
        if len(x) < linededup.MIN_BYTES:
            continue
        if x in first:
            later.add((d, i))
            continue
        if any(abs(len(x) - len(y)) <= 2 and maybe(x, y) and distance(x, y) <= 2 for y in first):
            later.add((d, i))
        first[x] = (d, i)
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in later) for d, t in rows}


def maybe(x, y):
    """Two edits change the counts of bytes by four at most."""
    a, b = Counter(x), Counter(y)
    return sum(((a - b) + (b - a)).values()) <= 4


@pytest.fixture(scope="module")
def stages(spark, small):
    """The rows after each stage."""
    docs, out = table(spark, small, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, small), "stage")
        out.append(docs)
    return out


def test_quality_stage_keeps_what_the_operator_keeps(spark, small, stages):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    want = {r.doc_id for r in quality.judge(docs, labels).where("keep").collect()}
    assert {r.doc_id for r in stages[0].collect()} == want and 0 < len(want) < docs.count()
    good = labels.where("quality = 1").join(stages[0], "doc_id", "left_anti").count()
    assert good <= 0.03 * labels.count()


def test_line_stage_equals_plain_code(stages):
    before = [(r.doc_id, r.text) for r in stages[0].collect()]
    after = {r.doc_id: r.text for r in stages[1].collect()}
    assert after == without_lines(before)
    assert all(r.n_chars == len(r.text) for r in stages[1].collect())


def test_near_duplicate_stage_equals_plain_code(stages):
    rows = [(r.doc_id, simhash.fingerprint(r.text)) for r in stages[1].collect()]
    assert {r.doc_id for r in stages[2].collect()} == {d for d, root in groups(rows).items() if d == root}


def test_mixing_stage_nears_its_targets(stages):
    taken, sources = mixing.copies(mixing._sized(stages[2], F.lit(0).cast("long").alias("row")))
    size = lambda t: len(re.findall(rb"[^\x20\x09-\x0D]+", t.encode()))         # noqa: E731
    words, most = Counter(), Counter()
    for r in stages[3].collect():
        words[r.source] += size(r.text)
        most[r.source] = max(most[r.source], size(r.text))
    for r in sources.collect():
        assert abs(words[r.source] - r.target) <= 2 * max(most[r.source], 50)
    assert max(Counter(r.doc_id for r in stages[3].collect()).values()) <= 3


def test_packing_stage_packs_every_copy(stages):
    copies = Counter(r.doc_id for r in stages[3].collect())
    pieces = stages[4].collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == copies
    fill = Counter()
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= packing.LENGTH
    assert len(fill) <= -(-sum(fill.values()) // packing.LENGTH) * 1.02 + 1


def test_run_and_contract(spark, small, stages, docs):
    assert [c for s in stages[:-1] for c in s.columns] == docs([]).columns * 4
    assert corpus_pipeline.run(spark, small).count() == stages[-1].count()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_rows(spark, small, docs):
    rows = [(1, None), (None, "some words here"), (2, ""), (3, "a plain line of text that is long enough. " * 3)] * 2
    frame = docs(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, small)
        assert frame.columns == docs([]).columns
        frame = store(frame, "odd")
    corpus_pipeline.STAGES[-1][1](spark, frame, small).count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs([]), small).count() == 0


def test_stages_keep_columns_that_are_named_like_helpers(spark, small, docs):
    from pyspark.sql import functions as F
    line = "a line of text that is long enough to be told from others, number %d"
    rows = [(i, "\n".join(line % (i * 7 + k) for k in range(5)) + "\n" + line % 1, "en", f"s{i % 2}") for i in range(12)]
    rows += [(3, rows[3][1], "en", "s1"), (None, rows[4][1], "en", "s0")]
    names = ["_key", "_id", "_row", "_n", "_i", "_lines", "_gone", "_kept", "_x_copies", "row", "n", "copies", "fp", "root", "a.b", "_f", "_c0"]
    plain = docs(rows)
    odd = plain.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in names],
                       F.create_map(F.lit("k"), F.col("doc_id")).alias("_map"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want, got = (store(stage(spark, frame, small), "clash") for frame in (plain, odd))
        assert got.columns == odd.columns and dict(got.dtypes) == dict(odd.dtypes)
        assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, want.collect())), name
        assert got.count() > 0
        for r in got.collect():
            assert all(r[c] == (None if r.doc_id is None else f"{c} {r.doc_id}") for c in names) and r["_map"] == {"k": r.doc_id}
    corpus_pipeline.STAGES[-1][1](spark, odd, small).count()


def test_row_hashes_tell_nulls_apart(spark):
    from lotvalue.llm.common import row_hash
    df = spark.createDataFrame([("x", None), (None, "x"), ("x", None)], "a string, b string")
    hashes = [r[0] for r in df.select(row_hash(df)).collect()]
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]
