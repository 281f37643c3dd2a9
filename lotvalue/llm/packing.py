"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

The genes are whole bins. Crossover injects the well-filled bins of one parent into the other, removes the bins that hold
a piece a second time, and puts the displaced pieces where they fit best. Pieces are dealt to shards of bounded size; each
shard is evolved on several islands (one task each) over several epochs, and between epochs the elite of every island
migrates to the next. Only keys and lengths travel, texts and token ids never do. A shard whose sequences equal the lower bound
(all tokens by the sequence length) is not evolved further.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

LENGTH = 2048
SHARD = 8192
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 4, 4
END = 0
#: Stands in text for the end of a document in this vocabulary, and is one token wherever it appears.
SPECIAL = "<|endoftext|>"


@cache
def _encoder(name: str):
    """text -> numpy ids. The ranks file holds the vocabulary of the tokenizer file and is several times as fast;
    what its pattern engine refuses (very long runs of white space) goes through the tokenizer itself."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={SPECIAL: slow.token_to_id(SPECIAL)})

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except Exception:                                           # a panic or a limit of the pattern engine
            return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")
    return encode


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens.

    >>> cut(2048), cut(5000)
    ([(0, 2048)], [(0, 904), (904, 2048), (2952, 2048)])
    """
    first = n % length
    return [(0, first)] * bool(first) + [(s, length) for s in range(first, n, length)]


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, key (unique)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, key long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, key = _encoder(vocabulary), TaskContext.get().partitionId() << 40
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(encode(text) if text else np.empty(0, "<u4"), np.uint32(END)).astype("<u4")
                for i, (start, length) in enumerate(cut(len(ids))):
                    out.append((doc_id, i, start, length, crc32(ids[start:start + length]), key))
                    key += 1
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 [c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _best_fit(bins: list[list[int]], items: list[int], size: list[int], capacity: int) -> list[list[int]]:
    """Adds ``items``, longest first, each to the fullest bin that has room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0
    for b in bins:
        left = capacity - sum(size[i] for i in b)
        room[left].append(b)
        open_ |= 1 << left
    for i in sorted(items, key=lambda i: (-size[i], i)):
        n = size[i]
        fits = open_ >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_ ^= 1 << left
            b.append(i)
        else:
            left, b = capacity, [i]
            bins.append(b)
        room[left - n].append(b)
        open_ |= 1 << (left - n)
    return bins


def _cross(a: list[list[int]], b: list[list[int]], size: list[int], capacity: int, share: float) -> list[list[int]]:
    """The best-filled ``share`` of the bins of ``b``, what of ``a`` they leave whole, and the displaced by best fit."""
    ranked = sorted(b, key=lambda x: -sum(size[i] for i in x))
    injected = [list(x) for x in ranked[:max(1, int(len(ranked) * share))]]
    taken = {i for x in injected for i in x}
    child, displaced = injected, []
    for x in a:
        if taken.isdisjoint(x):
            child.append(list(x))
        else:
            displaced += [i for i in x if i not in taken]
    return _best_fit(child, displaced, size, capacity)


def _shaken(a: list[list[int]], size: list[int], capacity: int, rng) -> list[list[int]]:
    """Mutation: empties the worst-filled bins and some others and fits their pieces anew."""
    fill = np.array([sum(size[i] for i in x) for x in a])
    gone = set(np.argsort(fill, kind="stable")[:max(2, len(a) // 50)].tolist()) | set(rng.integers(0, len(a), max(1, len(a) // 25)).tolist())
    return _best_fit([list(x) for k, x in enumerate(a) if k not in gone], [i for k in gone for i in a[k]], size, capacity)


def _fitness(a: list[list[int]], size: list[int]) -> tuple:
    return -len(a), sum(sum(size[i] for i in x) ** 2 for x in a)


def _bins(labels: np.ndarray) -> list[list[int]]:
    order = np.argsort(labels, kind="stable")
    cuts = np.flatnonzero(np.diff(labels[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)] if len(order) else []


def evolve(size: list[int], seeds: list[list[list[int]]], seed: int, capacity: int = LENGTH) -> list[list[int]]:
    """The best packing found, from ``seeds`` (packings of all items) on."""
    rng, least = np.random.default_rng(seed), -(-sum(size) // capacity)
    crowd = [[list(b) for b in s] for s in seeds]
    if not crowd:
        crowd = [_best_fit([], list(range(len(size))), size, capacity)]
    best = max(crowd, key=lambda x: _fitness(x, size))
    if len(best) == least or len(best) < 3:
        return best
    while len(crowd) < POPULATION:
        some = rng.permutation(len(size))[:len(size) // 4].tolist()      # a quarter goes first, in random order
        start: list[list[int]] = []
        for s in range(0, len(some), 64):
            start = _best_fit(start, some[s:s + 64], size, capacity)
        rest = sorted(set(range(len(size))).difference(some))
        crowd.append(_best_fit(start, rest, size, capacity))
    for _ in range(GENERATIONS):
        crowd.sort(key=lambda x: _fitness(x, size), reverse=True)
        if len(crowd[0]) == least:
            break
        a, b = crowd[0], crowd[1 + int(rng.integers(0, len(crowd) - 1))]
        crowd[-1] = _cross(a, b, size, capacity, float(rng.uniform(0.1, 0.6)))
        crowd[-2] = _cross(b, a, size, capacity, float(rng.uniform(0.1, 0.6)))
        crowd.append(_shaken(a, size, capacity, rng))
        crowd.sort(key=lambda x: _fitness(x, size), reverse=True)
        crowd.pop()
    return max([best, *crowd], key=lambda x: _fitness(x, size))


def _epoch(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("key", ignore_index=True)
    size = pdf["length"].tolist()
    seeds = [_bins(pdf[c].to_numpy()) for c in ("own", "migrant") if pdf[c].notna().all()]
    seed = int(pdf["shard"].iat[0]) * 1009 + int(pdf["island"].iat[0]) * 31 + int(pdf["epoch"].iat[0])
    labels, best = np.empty(len(pdf), np.int64), evolve(size, seeds, seed)
    for k, b in enumerate(best):
        labels[b] = k
    return pdf.assign(own=labels, bins=len(best))[["shard", "island", "key", "length", "own", "bins"]]


def _place(pdf: pd.DataFrame) -> pd.DataFrame:
    """The best island of a shard (the first, if equal) gives sequence numbers and offsets."""
    pdf = pdf[pdf["island"] == pdf.sort_values(["bins", "island"])["island"].iat[0]].sort_values(["own", "key"])
    offset = pdf["length"].cumsum() - pdf["length"]
    offset -= offset.groupby(pdf["own"]).transform("min")
    return pd.DataFrame({"key": pdf["key"], "sequence_id": pdf["shard"] * (1 << 32) + pdf["own"], "offset": offset})


def packed(docs: DataFrame) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end token alone. Every row is packed, also with a null or repeated doc_id. Pieces that
    fill a sequence get one without any search. Texts of any length are cut and packed whole. Other columns are ignored; no rows
    give no rows.
    """
    cut_up = store(pieces(docs), "pieces")
    part = cut_up.where(F.col("length") < LENGTH)
    shards = max(1, -(-part.count() // SHARD))
    state = (part.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "length")
             .withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
             .withColumn("own", F.lit(None).cast("long")).withColumn("migrant", F.lit(None).cast("long")))
    schema = "shard long, island int, key long, length long, own long, bins long"
    for epoch in range(EPOCHS):
        if epoch:
            elite = state.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), "key",
                                 F.col("own").alias("migrant"))
            state = state.join(elite, ["shard", "island", "key"])
        state = store(state.withColumn("epoch", F.lit(epoch)).groupBy("shard", "island")
                      .applyInPandas(_epoch, schema), "packings")
    placed = state.groupBy("shard").applyInPandas(_place, "key long, sequence_id long, offset long")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    alone = cut_up.where(F.col("length") == LENGTH) \
        .withColumn("sequence_id", -1 - F.col("key")).withColumn("offset", F.lit(0).cast("long"))
    return part.join(placed, "key").select(*columns).unionByName(alone.select(*columns))
