"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``RADIUS`` = 3 bits have a point in the middle. Half of 3 is one bit and a half: every
fingerprint emits, for each of three blocks of its 64 bits, the fingerprint without that block (which takes up one
difference or more) and all variants of the rest in which one bit is flipped (which take up one difference on either
side). Fingerprints that differ in up to three bits meet in a variant: leave out a block that holds a difference, and at
most two remain. The variants are shuffled, colliding fingerprints are deduplicated and their distance is verified.

A variant on which more than ``GROUP`` different fingerprints meet is not compared pair by pair: its fingerprints
go through whole balls instead (radius 1 on one side, radius 2 on the other; 2,146 variants each). There, whoever meets a
centre of the first kind is within 3 bits of it by the triangle inequality, so links form stars and their
number grows with the number of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, components, pick, row_hash, store

RADIUS = 3
SHINGLE = 3
SEED = 42
GROUP = 256
#: Fingerprints whose variants one task makes.
SPREAD = 16_384
BLOCKS = (range(0, 21), range(21, 42), range(42, 64))
_MOST_AT_ONCE = 100_000


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the 3-word shingles of ``text``; zero without a word.

    >>> fingerprint(None), fingerprint(" \\n")
    (0, 0)
    """
    words = (text or "").encode("utf-8").lower().split()        # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, _MOST_AT_ONCE):
        part = words[start:min(start + _MOST_AT_ONCE, n) + SHINGLE - 1]
        shingles = zip(*(part[i:] for i in range(SHINGLE))) if len(words) >= SHINGLE else [part]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(b" ".join(s), SEED) for s in shingles], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and ``fp`` (long), one row per row of ``docs``."""
    source = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    schema = ", ".join(f"_{i} {t}" for i, (_, t) in enumerate(source.dtypes[:-1])) + ", fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([fingerprint(t) for t in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], [*b.schema.names[:-1], "fp"])

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "fp")


def _variants() -> list:
    out = []
    for k, block in enumerate(BLOCKS):
        mask = sum(1 << b for b in block)
        tag = k << block[0]
        rest = F.col("fp").bitwiseAND(F.lit(_signed(~mask))).bitwiseOR(F.lit(_signed(tag)))
        flips = [0] + [1 << b for b in range(64) if b not in block]
        out += [rest.bitwiseXOR(F.lit(_signed(f))) for f in flips]
    return out


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= RADIUS      # of signed numbers it counts the absolute value


def _links_of(fps: np.ndarray) -> list[tuple[int, int]]:
    """A forest that joins the fingerprints of one variant as their links do."""
    near, label = _near(fps[:, None], fps[None, :]), np.arange(len(fps))
    while True:
        after = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (after == label).all():
            return [(int(fps[i]), int(fps[j])) for i, j in enumerate(label) if i != j]
        label = after


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, fp) in; verified links (a, b) out, and (a, null) for fingerprints of an overfull variant."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rest_k, rest_f, full = np.empty(0, np.int64), np.empty(0, np.int64), None

    def emit(k, f):
        nonlocal full
        first = np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)] if len(k) else np.zeros(1, int)
        size = np.diff(first)
        at = first[:-1][size == 2]
        a, b = f[at], f[at + 1]
        ok = _near(a, b) & (a != b)
        outs = [(a[ok], b[ok])]
        found, over = [], []
        for s, n in zip(first[:-1][size > 2], size[size > 2]):
            group = np.unique(f[s:s + n])
            if len(group) > GROUP or k[s] == full:
                full = k[s]
                over.append(group)
            elif len(group) > 1:
                found += _links_of(group)
        if found:
            x = np.array(found, np.int64)
            outs.append((x[:, 0], x[:, 1]))
        a, b = (np.concatenate(x) for x in zip(*outs))
        over = np.concatenate(over) if over else np.empty(0, np.int64)
        if len(a) + len(over):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[a, over]), pa.array(np.r_[b, np.zeros(len(over), np.int64)],
                                                    mask=np.r_[np.zeros(len(a), bool), np.ones(len(over), bool)])],
                schema=schema)

    for b in batches:
        k = np.r_[rest_k, b.column(0).to_numpy()]
        f = np.r_[rest_f, b.column(1).to_numpy()]
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1]))            # the last key may go on in the next batch
        if cut == 0 and len(k) > 4 * GROUP and len(np.unique(f)) > GROUP:
            yield from emit(k, f)                       # one key fills the batch: it is overfull already
            rest_k, rest_f = k[:0], f[:0]
            continue
        if full is not None and k[-1] == full:
            cut = len(k)
        done_k, done_f, rest_k, rest_f = k[:cut], f[:cut], k[cut:], f[cut:]
        alike = np.zeros(len(done_k), bool)
        same = done_k[1:] == done_k[:-1]
        alike[1:] |= same
        alike[:-1] |= same
        if full is not None:
            alike |= done_k == full
        if alike.any():
            yield from _padded(emit, done_k[alike], done_f[alike], full)
    if len(rest_k) > 1 or (full is not None and len(rest_k) and rest_k[0] == full):
        yield from _padded(emit, rest_k, rest_f, full)


def _padded(emit, k, f, full):
    """A key known as overfull counts as such however few of its rows are in this part."""
    if full is not None and len(k) and k[0] == full:
        n = int(np.searchsorted(k, full, "right"))
        yield from emit(np.r_[np.full(3, full), k], np.r_[np.full(3, f[0]), f]) if n < 3 else emit(k, f)
    else:
        yield from emit(k, f)


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = np.array([0] + [1 << i for i in range(64)], "<u8").view("<i8")
    two = np.array([0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i, j in combinations(range(64), 2)],
                   "<u8").view("<i8")
    for b in batches:
        every = b.column(0).to_numpy()
        for s in range(0, len(every), 200):
            f = every[s:s + 200]
            w = np.r_[(f[:, None] ^ one).ravel(), (f[:, None] ^ two).ravel()]
            centre = np.r_[np.ones(len(f) * len(one), bool), np.zeros(len(f) * len(two), bool)]
            fp = np.r_[np.repeat(f, len(one)), np.repeat(f, len(two))]
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(fp), pa.array(centre)], ["w", "fp", "centre"])


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints of column ``fp`` exactly as all pairs within 3 bits do."""
    distinct = store(fps.where("fp is not null").select("fp").distinct(), "distinct_fingerprints")
    # Few bytes become many rows here, so tasks are counted by rows: sized by bytes, one task would hold far too many.
    distinct = distinct.repartition(1 + distinct.count() // SPREAD, "fp")
    keyed = distinct.select(F.explode(F.array(*_variants())).alias("key"), "fp")
    met = store(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_meet, "a long, b long").distinct(),
                "met")
    balls = met.where("b is null").select("a").mapInArrow(_balls, "w long, fp long, centre boolean")
    centre = balls.where("centre").groupBy("w").agg(F.min("fp").alias("c"))
    stars = balls.where("not centre").join(centre, "w").where("fp <> c").select(F.col("fp").alias("a"),
                                                                               F.col("c").alias("b"))
    # Every fingerprint within 1 bit of w is linked to its smallest, too: it also has w in its radius-2 ball.
    return met.where("b is not null").unionByName(stars.distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null texts and texts without a word have fingerprint zero, which links like any other. Rows with a null doc_id take
    part, but never name a component: component_id is null only if all rows of a component lack a doc_id.
    Repeated rows are kept. Texts are read whole. Other columns of ``docs`` are ignored. No rows give no rows.
    """
    fps = store(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"]),
                "fingerprints")
    return _assigned(fps)


def _assigned(fps: DataFrame) -> DataFrame:
    """fps: doc_id, fp and more."""
    of = components(links(fps))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("_least"))
    rooted = (least.join(of.withColumnRenamed("node", "fp"), "fp", "left")
              .select("fp", F.coalesce("root", "fp").alias("_root"), "_least"))
    named = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = rooted.join(named, "_root").select("fp", "component_id")
    # Stored, so that the fingerprint of a third of all rows is a large partition that adaptive execution splits.
    return (fps.join(store(named, "component_of"), "fp")
            .select(*[c for c in fps.columns if c != "fp"],
                    F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


@carried
def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of each group of near-duplicates: the row with the smallest doc_id (null last).

    Ties go to the smallest hash of the row; of rows that are equal in every column one stays. A group whose rows all
    lack a doc_id keeps one row, too. Columns are those of ``docs``, whatever their names. Null and empty texts are near-duplicates
    of each other. No rows give no rows.
    """
    fps = store(fingerprints(docs.select("doc_id", "text", row_hash(docs).alias("row")), ["doc_id", "row"]),
                "fingerprints")
    of = components(links(fps)).withColumnRenamed("node", "fp")
    best = fps.groupBy("fp", "doc_id", "row").agg(F.count("*").alias("n")).groupBy("fp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "n")).alias("best"))
    best = best.join(of, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best"))
    return pick(docs, store(best.select("best.doc_id", "best.row", "best.n"), "kept_rows"))
