import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lotvalue.llm import packing
from lotvalue.llm.common import table


def check(got, texts):
    """Every piece right, every sequence gapless and no longer than allowed."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: t.encode(x or "", add_special_tokens=False).ids + [0] for d, x in texts.items()}
    of, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        of[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert of.keys() == ids.keys()
    for d, rows in of.items():
        rows.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in rows] == [(i, *x) for i, x in enumerate(packing.cut(len(ids[d])))]
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return len(sequences), -(-sum(map(len, ids.values())) // 2048)


def test_documents(spark, small):
    docs = table(spark, small, "documents")
    used, least = check(packing.packed(docs).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert least <= used <= least * 1.02 + 1


def test_tokens_equal_the_tokenizer(small, spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode, rng = packing._encoder("byte_bpe_50k"), random.Random(3)
    for _ in range(3000):
        s = "".join(rng.choices("ab Z09 \n\t  \x85é中'’sS.,!٣\U0001F600<|endoftext|>\x1c\0", k=rng.randrange(1, 40)))
        s += "<|endoftext|>" * (rng.random() < 0.1)
        assert encode(s).tolist() == t.encode(s, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(3))
def test_evolution_keeps_pieces_and_gains(seed):
    rng = random.Random(seed)
    size = [rng.randrange(500, 1100) for _ in range(300)]
    plain = packing._best_fit([], list(range(300)), size, 2048)
    best = packing.evolve(size, [], seed)
    assert sorted(i for b in best for i in b) == list(range(300))
    assert all(sum(size[i] for i in b) <= 2048 for b in best)
    assert packing._fitness(best, size) >= packing._fitness(plain, size)
    child = packing._cross(plain, packing._shaken(plain, size, 2048, np.random.default_rng(seed)), size, 2048, 0.4)
    assert sorted(i for b in child for i in b) == list(range(300))


def test_shards_and_islands(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 50)
    texts = {i: "word " * random.Random(i).randrange(300, 1500) for i in range(120)}
    used, least = check(packing.packed(docs(list(texts.items()))).collect(), texts)
    assert used <= 120


def test_edges(spark, docs):
    rows = [(1, None), (2, ""), (None, "a"), (3, "b"), (3, "b")]
    frame = docs(rows).withColumn("key", F.lit(1)).withColumn("offset", F.lit("x"))
    got = packing.packed(frame).collect()
    assert len(got) == 5 and len({r.sequence_id for r in got}) == 1
    assert sorted(r.offset for r in got) == [0, 1, 2, 4, 6]
    assert packing.packed(docs([])).count() == 0
    exact = "a" + " a" * 2046                                       # 2,047 tokens and the end
    got = packing.packed(docs([(7, exact), (8, exact + " a")])).orderBy("doc_id", "piece").collect()
    assert [(r.doc_id, r.start, r.length) for r in got] == [(7, 0, 2048), (8, 0, 1), (8, 1, 2048)]
