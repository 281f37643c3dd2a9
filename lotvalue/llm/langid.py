"""Language identification by n-gram filters that hold a bitmask of languages.

The n-grams are three bytes of lower-cased UTF-8 text around a letter; signs count as white space. A language contains an
n-gram if it is at least ``RATIO`` times as frequent there as in the language where it is most frequent, counted over all
learned texts. All languages share one bit-sliced Bloom filter: an array of ``SLOTS`` bitmasks with one bit per language, in which an n-gram sets
its languages' bits in ``HASHES`` slots. One lookup ANDs these slots and returns every language that contains the
n-gram. A text is counted per language (the popcount of that language's slice over its n-grams); from each share the
language's false-positive rate (its fill to the power of ``HASHES``) is taken out. The highest share decides, ties go to the
first language by name.

Only the filter reaches the driver: ``SLOTS`` masks of eight bytes per 64 languages, whatever the input.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

SLOTS = 1 << 19
HASHES = 3
RATIO = 0.25
#: Seen less often than this in a language, an n-gram is no mark of it.
LEAST = 3
NONE = "und"
_STEP = 1 << 21
_BLANK = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def letters(text: str | None) -> bytes:
    """Lower-cased UTF-8 with a blank at either end and for every sign.

    >>> letters("Été, 2!")
    b' \\xc3\\xa9t\\xc3\\xa9     '
    """
    return b" " + (text or "").lower().encode("utf-8").translate(_BLANK) + b" "


def grams(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that starts at each byte, and whether its middle is part of a word."""
    x = buffer.astype(np.uint32)
    return x[:-2] << 16 | x[1:-1] << 8 | x[2:], buffer[1:-1] != 32


def slots(codes: np.ndarray) -> Iterator[np.ndarray]:
    wide = codes.astype(np.uint64)
    for f in _FACTORS[:HASHES]:
        yield ((wide * np.uint64(f)) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def counts(learned: DataFrame) -> DataFrame:
    """learned (text, lang) -> lang, gram, n over all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)

        def add(lang, codes):
            found = np.bincount(codes, minlength=1 << 24)
            at = np.flatnonzero(found)
            held[lang].append((at, found[at]))
            if len(held[lang]) > 8:
                held[lang] = [merged(held[lang])]

        def merged(parts):
            at, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return at, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)

        for b in batches:
            texts = defaultdict(list)
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts[lang].append(letters(t))
            for lang, some in texts.items():
                buffer = np.frombuffer(b"".join(some), np.uint8)
                for s in range(0, len(buffer) - 2, _STEP * 4):
                    codes, inside = grams(buffer[s:s + _STEP * 4 + 2])
                    add(lang, codes[inside])
        for lang, parts in held.items():
            at, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int64()), pa.array(n)],
                                             ["lang", "gram", "n"])

    rows = learned.mapInArrow(run, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filter:
    """languages (sorted), masks (slots x words of 64 languages), false-positive rate per language."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks
        fill = [((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))]
        self.false = np.array(fill) ** HASHES

    def look_up(self, codes: np.ndarray) -> np.ndarray:
        found = None
        for s in slots(codes):
            found = self.masks[s] if found is None else found & self.masks[s]
        return found

    def tally(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams per text, and of these per language those that it contains."""
        parts = [letters(t) for t in texts]
        ends = np.cumsum([len(p) for p in parts])
        buffer = np.frombuffer(b"".join(parts), np.uint8)
        n, hits = np.zeros(len(parts), np.int64), np.zeros((len(parts), len(self.languages)), np.int64)
        for s in range(0, max(0, len(buffer) - 2), _STEP):
            codes, inside = grams(buffer[s:s + _STEP + 2])
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            masks = self.look_up(codes[at])
            doc = np.searchsorted(ends, at + s, side="right")
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            own = doc[first]
            n[own] += np.diff(np.r_[first, len(doc)])
            for i in range(len(self.languages)):
                bit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                hits[own, i] += np.add.reduceat(bit.astype(np.int64), first)
        return n, hits

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [NONE] * len(texts), [0.0] * len(texts)
        n, hits = self.tally(texts)
        share = (hits / np.maximum(n, 1)[:, None] - self.false) / np.maximum(1 - self.false, 1e-9)
        best = share.argmax(axis=1)
        score = np.clip(share[np.arange(len(texts)), best], 0, 1)
        known = [t is not None and any(map(str.isalpha, t)) for t in texts]
        return ([self.languages[i] if k else NONE for i, k in zip(best, known)],
                [float(s) if k else 0.0 for s, k in zip(score, known)])


def learn(learned: DataFrame) -> Filter:
    """learned (text, lang) -> the filter."""
    found = store(counts(learned), "gram_counts")
    totals = found.groupBy("lang").agg(F.sum("n").alias("total"))
    languages = sorted(r.lang for r in totals.select("lang").collect())         # one row per language
    rate = found.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    most = rate.groupBy("gram").agg(F.max("rate").alias("most"))
    marks = rate.join(most, "gram").where(f"rate >= {RATIO} * most and n >= {LEAST}").select("gram", "lang")
    masks = np.zeros((SLOTS, max(1, -(-len(languages) // 64))), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(languages)}
        for b in batches:
            i = np.array([place[x] for x in b.column(1).to_pylist()], np.int64)
            bit = np.left_shift(np.uint64(1), (i % 64).astype(np.uint64)).view(np.int64)
            for s in slots(b.column(0).to_numpy().astype(np.uint32)):
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(i // 64), pa.array(bit)],
                                                 ["slot", "word", "bit"])

    bits = marks.mapInArrow(run, "slot long, word long, bit long").groupBy("slot", "word").agg(F.bit_or("bit").alias("m"))
    for r in bits.toLocalIterator():                                            # SLOTS rows per 64 languages at most
        masks[r.slot, r.word] = np.uint64(r.m & (1 << 64) - 1)
    return Filter(languages, masks)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (0 to 1).

    Learns from the rows that are not held out and have a text and a lang. A text that is null or has no letter is ``und``
    with score 0; without any row to learn from all are. A null doc_id is not held out. Texts are read
    whole; of equal scores the first language by name wins. No rows give no rows. Other columns are ignored.
    """
    known = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = docs.sparkSession.sparkContext.broadcast(learn(known.select("text", "lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = model.value.decide(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")
