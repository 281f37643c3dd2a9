"""Periodic runs of words, by Baier's grouping.

A run is a stretch of words that repeats itself at a distance, its period, and that no neighbour extends. Its shifts by one
period share a Lyndon word, the run's root, under one of the two orders of the words. The first phase of Baier's suffix
sorter gives the longest Lyndon word at each place directly: suffixes are grouped by their first word, groups are taken from
the highest to the lowest, and every suffix of a group lends the group's common prefix to the nearest suffix at its left that
is lower, which moves up accordingly. The prefix that a suffix has when its group is taken is its longest Lyndon word. This
is done under both orders; each root is then extended to both sides by longest common extensions.

Beforehand a text is cut where no run can be: every three words in a row of a run of four periods or more occur
again inside it, so words around which they do not are outside of all runs. The cut is exact and saves the slow part on plain text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERIODS = 4
LEAST = 6
_SLICE = 128
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:long,length:long,period:long>>"


def lyndon(x: list[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at each place of ``x``.

    >>> lyndon([1, 0, 1, 0, 1])
    [1, 2, 1, 2, 1]
    """
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(x):
        by_symbol.setdefault(c, []).append(i)
    held = [by_symbol[c] for c in sorted(by_symbol)]        # groups, lowest first; members that moved on are left behind
    live, size = [len(h) for h in held], [1] * len(held)
    lower, upper = [g - 1 for g in range(len(held))], [g + 1 for g in range(len(held))]
    group, parent, done, out = [0] * len(x), [-1] * len(x), bytearray(len(x)), [0] * len(x)
    for g, own in enumerate(held):
        for i in own:
            group[i] = g

    def raised(some, h, by):
        """Members ``some`` of group ``h`` get a prefix longer by ``by``: they stay if all do, else form the next higher group."""
        if live[h] == len(some):
            size[h] += by
            return
        new = len(held)
        held.append(some)
        live.append(len(some))
        live[h] -= len(some)
        size.append(size[h] + by)
        lower.append(h)
        upper.append(upper[h])
        lower[upper[h]] = new                               # a group stands above every one that is not yet taken
        upper[h] = new
        for p in some:
            group[p] = new

    g = len(held) - 1
    while g >= 0:
        own, w = held[g], size[g]
        if live[g] < len(own):
            own = [i for i in own if group[i] == g]
        if len(own) == 1:
            i = own[0]
            out[i], done[i], p = w, 1, i - 1
            while p >= 0 and done[p]:
                p = parent[p]
            parent[i] = p
            if p >= 0:
                raised([p], group[p], w)
        else:
            own.sort()
            for i in own:
                out[i], done[i] = w, 1
            children: dict[int, int] = {}
            for i in own:
                p = i - 1
                while p >= 0 and done[p]:
                    p = parent[p]
                parent[i] = p
                if p >= 0:
                    children[p] = children.get(p, 0) + 1
            moved: dict[tuple[int, int], list[int]] = {}
            for p, n in children.items():
                moved.setdefault((n, group[p]), []).append(p)
            for n, h in sorted(moved, reverse=True):        # more copies of the prefix make a higher group
                raised(moved[n, h], h, n * w)
        g = lower[g]
    return out


def extension(x: np.ndarray, i: int, j: int) -> int:
    """How many words agree from ``i`` and from ``j`` > ``i`` on; compared in blocks of doubling size."""
    k, step, n = 0, 16, len(x)
    while j + k < n:
        m = min(step, n - j - k)
        differ = x[i + k:i + k + m] != x[j + k:j + k + m]
        at = int(differ.argmax())
        if differ[at]:
            return k + at
        k, step = k + m, step * 2
    return k


def runs(x: np.ndarray, periods: int = PERIODS, least: int = LEAST) -> set[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``periods`` (2 or more) periods and ``least`` words."""
    n, found, back = len(x), set(), x[::-1]
    for order in (x, -x):
        q = np.array(lyndon(order.tolist()), np.int64)
        i = np.arange(n)
        for k in range(1, periods - 1):                     # a run holds periods - 1 whole roots in a row
            i = i[i + (k + 1) * q[i] <= n]
            i = i[(q[i + k * q[i]] == q[i]) & (x[i + k * q[i]] == x[i])]
        i = i[i + q[i] < n]
        i = i[x[i + q[i]] == x[i]]
        period, end = 0, 0
        for at in i[np.lexsort((i, q[i]))].tolist():
            own = int(q[at])
            if own != period:
                period, end = own, 0
            if at + own < end:                              # this root belongs to a run already found
                continue
            start = at - extension(back, n - at - own, n - at)
            end = at + own + extension(x, at, at + own)
            if end - start >= max(least, periods * own):
                found.add((start, end - start, own))
    return found


def stretches(x: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches (from, to) of words of which every three in a row occur again in ``x``, six words or more.

    Three words are compared by a hash: a stretch may come out too long, never too short.
    """
    if len(x) < LEAST:
        return []
    y, bits = x.astype(np.uint64), len(x).bit_length() + 3
    slot = (((y[:-2] * _FACTOR + y[1:-1]) * _FACTOR + y[2:]) * _FACTOR >> np.uint64(64 - bits)).astype(np.int64)
    again = np.bincount(slot, minlength=1 << bits)[slot] > 1
    edge = np.diff(np.r_[False, again, False].astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 2
    long = stop - start >= LEAST
    return list(zip(start[long].tolist(), stop[long].tolist()))


def pieces(x: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of ``x`` that hold all runs of four periods and six words or more, cut until they hardly shrink."""
    todo, done = [(0, len(x))], []
    while todo:
        a, b = todo.pop()
        for s, t in stretches(x[a:b]):
            (done if t - s > 0.9 * (b - a) else todo).append((a + s, a + t))
    return done


def read(text: bytes | None) -> tuple[list[tuple[int, int, int]], bytes]:
    """The runs of a text in words, and the text without the repetitions, its words joined by one space."""
    words = (text or b"").split()                           # at bytes 9 to 13 and 32
    codes: dict[bytes, int] = {}
    x = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
    found = {(s + a, n, q) for a, b in pieces(x) for s, n, q in runs(x[a:b])}
    if not found:
        return [], b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for s, n, q in found:
        drop[s + q] += 1
        drop[s + n] -= 1
    kept = np.cumsum(drop)[:-1] == 0
    return sorted(found, key=lambda r: (r[0], r[2])), b" ".join([w for w, k in zip(words, kept.tolist()) if k])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, runs (start, length, period), collapsed.

    Words are stretches of characters other than ASCII white space, numbered from 0. runs: every run of at least four
    periods and six words, by start, then period; the period is the smallest. collapsed: the words that are in no run after its first
    period, joined by one space. A null, empty or blank text has no run and an empty ``collapsed``. Repeated rows and
    repeated or null doc_ids are rows of their own, an empty table gives an empty one, other columns are ignored.
    Texts are read one by one and whole: memory grows with the longest text, time with its words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, _SLICE):
                b = whole.slice(s, _SLICE)
                found, kept = zip(*(read(t.as_py()) for t in b.column(1)))
                flat = np.array([r for own in found for r in own], np.int64).reshape(-1, 3)
                ends = np.cumsum([0, *map(len, found)])
                structs = pa.StructArray.from_arrays([pa.array(c) for c in flat.T.copy()], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs), pa.array(kept, pa.binary())],
                    ["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs {RUNS}, collapsed binary") \
        .withColumn("collapsed", F.col("collapsed").cast("string"))
