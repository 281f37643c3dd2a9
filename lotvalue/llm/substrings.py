"""Removal of repeated substrings with a sparse suffix array in deep-shallow order.

A byte goes if a string of ``LENGTH`` bytes around it also starts anywhere else. Sorting all suffixes of a corpus would move
every byte ``LENGTH`` times, so only anchors are sorted: the smallest ``GRAM``-byte gram (by hash, leftmost) of every window
of ``LENGTH`` bytes. Equal windows have their anchor at the same place, so a repeat is always seen from an anchor that it holds.

1. The shuffle on the hash of the anchor's gram is the shallow part of the order: suffixes that share no gram part.
2. Anchors of grams that occur once are done. For the others the text around is fetched, up to
   ``LENGTH`` bytes on the right and ``LENGTH - GRAM`` on the left.
3. Within a gram, different suffixes are ordered by multikey quicksort down to ``SHALLOW`` bytes; groups that are still
   equal there go into a blind trie, which compares one byte per branch on the way down and one whole pair per suffix. The
   same is done for the reversed text on the left. The order gives the common prefixes of neighbours, and their running minimum
   those of all pairs.
4. Two anchors with L common bytes on the left and R on the right share the string [-L, R); it counts if L + R >= LENGTH.

A gram with more than ``FULL`` different surroundings is not held in one task: its windows are hashed one by one,
and counted by a grouped aggregation. Texts are compared once per distinct text; copies of a whole text need no comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, store

LENGTH = 200
GRAM = 64
LEFT = LENGTH - GRAM
SHALLOW = 24
FULL = 20_000
PAIRS = 24
_STEP = (1 << 20) - LENGTH
_B = 0x9E3779B97F4A7C15 | 1
_ONE = (1 << 64) - 1


def _powers() -> tuple[np.ndarray, np.ndarray]:
    up = np.full(_STEP + LENGTH + 1, _B, np.uint64)
    down = np.full(_STEP + LENGTH + 1, pow(_B, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def anchors(buffer: np.ndarray, ends: np.ndarray, powers) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the anchors in a buffer of texts (ends: where each ends), and hashes of their grams."""
    up, down = powers
    for s in range(0, max(0, len(buffer) - LENGTH + 1), _STEP):
        x = buffer[s:s + _STEP + LENGTH - 1]
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * down[:len(x)], out=total[1:])
        grams = _mixed((total[GRAM:] - total[:-GRAM]) * up[:len(x) - GRAM + 1])
        at = np.arange(len(grams), dtype=np.uint64)
        packed = (grams & np.uint64(_ONE ^ ((1 << 20) - 1))) | at       # by hash, then leftmost
        w = LENGTH - GRAM + 1
        rows = -(-len(packed) // w)
        padded = np.full(rows * w, _ONE, np.uint64)
        padded[:len(packed)] = packed
        head = np.minimum.accumulate(padded.reshape(rows, w), axis=1).ravel()
        tail = np.minimum.accumulate(padded.reshape(rows, w)[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(x) - LENGTH + 1
        least = np.minimum(tail[:n], head[w - 1:w - 1 + n])
        start = np.arange(s, s + n)
        whole = ends[np.searchsorted(ends, start, side="right")] >= start + LENGTH        # within one text
        chosen = np.zeros(len(grams), bool)
        chosen[(least[whole] & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        found = np.flatnonzero(chosen)
        yield found + s, _mixed(grams[found] + np.uint64(1)).view(np.int64)


def _identity():
    return F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")


def anchor_rows(texts: DataFrame) -> DataFrame:
    """texts (text, h1, h2) -> h1, h2, pos, gram."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers()
        for b in batches:
            data = [t.encode("utf-8") for t in b.column(0).to_pylist()]
            h1, h2 = b.column(1).to_numpy(), b.column(2).to_numpy()
            ends = np.cumsum([len(d) for d in data])
            buffer = np.frombuffer(b"".join(data), np.uint8)
            for at, gram in anchors(buffer, ends, powers):
                of = np.searchsorted(ends, at, side="right")
                pos = at - np.r_[0, ends][of]
                yield pa.RecordBatch.from_arrays([pa.array(h1[of]), pa.array(h2[of]), pa.array(pos.astype(np.int64)),
                                                  pa.array(gram)], ["h1", "h2", "pos", "gram"])

    # An anchor may be seen from both sides of a step; the aggregation takes it once.
    return texts.mapInArrow(run, "h1 long, h2 long, pos long, gram long")


def _squeezed(texts: DataFrame, *more: str) -> DataFrame:
    """more columns, h1, h2, and z: the text compressed, so that less of it is shuffled."""
    source = texts.select(*more, "h1", "h2", "text")
    schema = ", ".join(f"`{c}` {t}" for c, t in source.dtypes[:-1]) + ", z binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            z = [press((t or "").encode("utf-8")) for t in b.columns[-1].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(z, pa.binary())], [*b.schema.names[:-1], "z"])

    return source.mapInArrow(run, schema)


def _read(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def surroundings(held: DataFrame) -> DataFrame:
    """held (h1, h2, z, at: array of (pos, gram)) -> h1, h2, pos, gram, left (reversed), right, e.

    What a text repeats within itself with all its surroundings, as one that says one word again and again does at every
    few bytes, is settled here: such places come as spans (pos to e, no left), and one of them as an anchor for others.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h1, h2, z, at in zip(*(c.to_pylist() for c in b.columns)):
                data, alike = _read(z), {}
                for a in at:
                    p = a["pos"]
                    left, right = data[max(0, p - LEFT):p][::-1], data[p:p + LENGTH]
                    if len(left) + len(right) >= LENGTH:        # else no string of that length holds the gram
                        alike.setdefault((a["gram"], left, right), []).append(p)
                rows += [(h1, h2, some[0], gram, left, right, None) for (gram, left, right), some in alike.items()]
                spans = [(p - len(left), p + len(right)) for (_, left, right), some in alike.items() if len(some) > 1
                         for p in some]
                rows += [(h1, h2, s, h1, None, None, e) for s, e in _merged(spans)]
                if len(rows) > 20_000:
                    yield _batch(rows, _AROUND)
                    rows = []
            if rows:
                yield _batch(rows, _AROUND)

    return held.select("h1", "h2", "z", "at").mapInArrow(
        run, "h1 long, h2 long, pos long, gram long, left binary, right binary, e long")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _merged(spans) -> list[list[int]]:
    """Spans [start, end) that touch or overlap as one, in order."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Orders different strings: nodes hold a depth and one byte per branch (-1: the string ends there), leaves a string."""

    def __init__(self, first: bytes):
        self.root: object = first

    def add(self, s: bytes) -> None:
        node, path = self.root, []
        while isinstance(node, tuple):                      # down without comparing what lies between branches
            depth, branches = node
            byte = s[depth] if depth < len(s) else -1
            path.append((node, byte if byte in branches else next(iter(branches))))
            node = branches[path[-1][1]]
        at = common(s, node)                                # one comparison with whatever leaf was reached
        k = next((k for k, (n, _) in enumerate(path) if n[0] >= at), len(path))
        byte = s[at] if at < len(s) else -1
        if k < len(path) and path[k][0][0] == at:
            path[k][0][1][byte] = s
            return
        below = path[k][0] if k < len(path) else node
        other = node[at] if at < len(node) else -1
        fresh = (at, {other: below, byte: s})
        if k:
            parent, branch = path[k - 1]
            parent[1][branch] = fresh
        else:
            self.root = fresh

    def ordered(self) -> tuple[list[bytes], list[int]]:
        """The strings in order, and the common prefix of each with the one before."""
        out, before, todo = [], [], [(self.root, 0)]
        while todo:
            node, depth = todo.pop()
            if isinstance(node, tuple):
                branches = sorted(node[1].items(), reverse=True)
                todo += [(x, node[0]) for _, x in branches[:-1]] + [(branches[-1][1], depth)]
            else:
                out.append(node)
                before.append(depth)
        return out, before


def deep_shallow(strings: list[bytes]) -> tuple[list[bytes], list[int]]:
    """Different strings in order, with the common prefix of each with the one before (0 for the first)."""
    out, before, todo = [], [], [(strings, 0, 0)]
    while todo:
        some, depth, prefix = todo.pop()
        if len(some) == 1:
            out.append(some[0])
            before.append(prefix)
        elif depth >= SHALLOW:
            trie = BlindTrie(some[0])
            for s in some[1:]:
                trie.add(s)
            ordered, inner = trie.ordered()
            out += ordered
            before += [prefix, *inner[1:]]
        else:                                               # multikey quicksort: three parts by one byte
            pivot = some[len(some) // 2][depth:depth + 1]
            less, same, more = [], [], []
            for s in some:
                c = s[depth:depth + 1]
                (less if c < pivot else same if c == pivot else more).append(s)
            after = [(less, depth, prefix), (same, depth + 1 if pivot else SHALLOW, depth if less else prefix),
                     (more, depth, depth)]
            after = [x for x in after if x[0]]
            todo += after[::-1]
    return out, before


def shared(left: list[bytes], right: list[bytes]) -> list[tuple[int, int] | None]:
    """Of different (left, right) surroundings of one gram: how far repeated strings reach on either side, if there are any.

    All strings that count hold the gram, so together they are one span.
    """
    n = len(left)
    orders = []
    for side in (left, right):
        distinct, before = deep_shallow(list(dict.fromkeys(side)))
        rank = {s: k for k, s in enumerate(distinct)}
        orders.append(([rank[s] for s in side], before, [len(s) for s in distinct]))
    (lr, lb, ll), (rr, rb, rl) = orders
    reach = np.full((n, 2), -1)
    if n <= PAIRS:
        for i in range(n):
            for j in range(i):
                a, b = sorted((rr[i], rr[j]))
                r = rl[a] if a == b else min(rb[a + 1:b + 1])
                if r < GRAM:
                    continue                                # another gram with the same hash
                a, b = sorted((lr[i], lr[j]))
                k = ll[a] if a == b else min(lb[a + 1:b + 1])
                if k + r >= LENGTH:
                    reach[[i, j]] = np.maximum(reach[[i, j]], (k, r))
    else:
        # Many: for every k the classes of equal lefts of k bytes and equal rights of LENGTH - k bytes, from the two orders.
        lr, rr = np.array(lr), np.array(rr)
        lb, rb, ll, rl = map(np.array, (lb, rb, ll, rl))
        for k in range(LEFT + 1):
            live = np.flatnonzero((ll[lr] >= k) & (rl[rr] >= LENGTH - k))
            key = np.cumsum(lb < k)[lr[live]] * np.int64(len(rb) + 1) + np.cumsum(rb < LENGTH - k)[rr[live]]
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            again = live[count[inverse] > 1]
            reach[again] = np.maximum(reach[again], (k, LENGTH - k))
    return [(int(a), int(b)) if b >= 0 else None for a, b in reach]


_AROUND = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("pos", pa.int64()), ("gram", pa.int64()),
                     ("left", pa.binary()), ("right", pa.binary()), ("e", pa.int64())])
_FOUND = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("s", pa.int64()), ("e", pa.int64()),
                    ("left", pa.binary()), ("right", pa.binary())])


def _of_gram(rows: dict) -> list[tuple]:
    """rows: (left, right) -> (h1, h2, pos), or None where it was met again, of one gram."""
    keys = list(rows)
    if len(keys) < 2:
        return []
    told = shared([k[0] for k in keys], [k[1] for k in keys])
    return [(h1, h2, pos - some[0], pos + some[1], None, None)
            for some, at in zip(told, rows.values()) if some and at for h1, h2, pos in (at,)]


def repeats(around: DataFrame) -> DataFrame:
    """surroundings -> (h1, h2, s, e): repeated strings; with left and right kept (s the anchor) for overfull grams.

    Surroundings that occur again are repeated as a whole, so only one place of each is held, and none once that is known.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, rows, full, out = None, {}, False, []
        for b in batches:
            for h1, h2, pos, g, left, right, e in zip(*(c.to_pylist() for c in b.columns)):
                if left is None:
                    out.append((h1, h2, pos, e, None, None))
                    continue
                if g != gram:
                    if not full:
                        out += _of_gram(rows)
                    gram, rows, full = g, {}, False
                key, whole = (left, right), (h1, h2, pos - len(left), pos + len(right), None, None)
                if full:
                    out.append((h1, h2, pos, None, left, right))
                elif key in rows:
                    out.append(whole)
                    if first := rows[key]:
                        out.append((first[0], first[1], first[2] - len(left), first[2] + len(right), None, None))
                        rows[key] = None
                else:
                    rows[key] = (h1, h2, pos)
                    if len(rows) > FULL:                    # those met again stand in for themselves as text (0, 0)
                        out += [(*(x or (0, 0, 0)), None, *k) for k, x in rows.items()]
                        rows, full = {}, True
                if len(out) > 20_000:
                    yield _batch(out, _FOUND)
                    out = []
        if not full:
            out += _of_gram(rows)
        if out:
            yield _batch(out, _FOUND)

    return around.repartition("gram").sortWithinPartitions("gram").select(
        "h1", "h2", "pos", "gram", "left", "right", "e").mapInArrow(
        run, "h1 long, h2 long, s long, e long, left binary, right binary")


_WINDOW = pa.schema([(c, pa.int64()) for c in ("w1", "w2", "h1", "h2", "s")])


def _windows(full: DataFrame) -> DataFrame:
    """Repeated windows of overfull grams, each window by its hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h1, h2, pos, left, right in zip(*(c.to_pylist() for c in b.columns)):
                data, k = left[::-1] + right, len(left)
                for i in range(len(data) - LENGTH + 1):
                    c = xxhash.xxh3_128_intdigest(data[i:i + LENGTH])
                    rows.append(((c >> 64) - (1 << 63), (c & _ONE) - (1 << 63), h1, h2, pos - k + i))
                if len(rows) > 20_000:
                    yield _batch(rows, _WINDOW)
                    rows = []
            if rows:
                yield _batch(rows, _WINDOW)

    seen = full.select("h1", "h2", F.col("s").alias("pos"), "left", "right").mapInArrow(
        run, "w1 long, w2 long, h1 long, h2 long, s long")
    at = F.struct("h1", "h2", "s")
    twice = seen.groupBy("w1", "w2").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a <> b").select("w1", "w2")
    return seen.where("h1 <> 0 or h2 <> 0").join(twice, ["w1", "w2"], "left_semi").select("h1", "h2", "s", (F.col("s") + LENGTH).alias("e"))


def _kept(rows: DataFrame, text: bool) -> DataFrame:
    """doc_id, z, every (the whole text is repeated), spans -> the digest, with the kept bytes if ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, z, every, spans in zip(*(c.to_pylist() for c in b.columns)):
                data, at, kept = _read(z), 0, []
                gone = [(0, len(data))] if every and len(data) >= LENGTH else _merged((x["s"], x["e"]) for x in spans or ())
                for s, e in gone:
                    kept.append(data[at:s])
                    at = e
                kept.append(data[at:])
                rest = b"".join(kept)
                out.append((doc_id, len(data), len(data) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(),
                            rest if text else None))
            if out:
                kinds = (pa.int64(),) * 4 + (pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.select("doc_id", "z", "every", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def without_repeats(docs: DataFrame, text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (bytes;
    null unless ``text``).

    A null text counts as empty. Rows with a null doc_id and repeated rows are kept; a text that occurs twice is
    removed whole if it has ``LENGTH`` bytes or more. Texts of any length are read whole. Other
    columns of ``docs`` are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", *_identity())
    found = store(anchor_rows(texts.where(F.octet_length("text") >= LENGTH).select("text", "h1", "h2")), "anchors")
    at = F.struct("h1", "h2", "pos")
    # One gram twice in copies of one text only is no matter for comparison: copies are settled as a whole.
    again = found.groupBy("gram").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a <> b").select("gram")
    again = store(again, "repeated_grams")      # stored, so that a gram with a third of all anchors can be split
    of_text = found.join(again, "gram", "left_semi").groupBy("h1", "h2").agg(
        F.collect_set(F.struct("pos", "gram")).alias("at"))
    of_text = store(of_text, "repeated_anchors")
    release(spark)
    one = _squeezed(texts.where(F.octet_length("text") >= LENGTH)).groupBy("h1", "h2").agg(F.any_value("z").alias("z"))
    seen = store(repeats(surroundings(one.join(of_text, ["h1", "h2"]))), "repeats")
    release(spark)
    spans = seen.where("left is null").select("h1", "h2", "s", "e").unionByName(_windows(seen.where("left is not null")))
    spans = spans.groupBy("h1", "h2").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    twice = texts.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2", F.lit(True).alias("every"))
    told = store(spans.join(twice, ["h1", "h2"], "full"), "text_spans")
    release(spark)
    return _kept(_squeezed(texts, "doc_id").join(told, ["h1", "h2"], "left"), text)
