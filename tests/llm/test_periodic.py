import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotvalue.llm import periodic
from lotvalue.llm.common import table
from lotvalue.llm.queries import QUERIES


def plain_lyndon(x):
    return [max(j - i for j in range(i + 1, len(x) + 1) if all(x[i:j] < x[k:j] for k in range(i + 1, j))) for i in range(len(x))]


def brute(x, periods=4, least=6):
    """Every stretch that agrees with itself at a distance, the smallest distance for each."""
    out = set()
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, periods * q) and not any(
                    s <= i and s + n >= j + q and q % p == 0 for s, n, p in out):
                out.add((i, j + q - i, q))
            i = j + 1
    return out


def some_texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        x = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 50))]
        if rng.random() < 0.6:
            unit, at = [rng.randint(0, 3) for _ in range(rng.randint(1, 9))], rng.randint(0, len(x))
            x = x[:at] + unit * rng.randint(2, 6) + unit[:rng.randint(0, len(unit))] + x[at:]
        yield x


def test_lyndon_words():
    for x in some_texts(1, 300):
        assert periodic.lyndon(x) == plain_lyndon(x)
        y = [-c for c in x]
        assert periodic.lyndon(y) == plain_lyndon(y)


@pytest.mark.parametrize("periods", [2, 3, 4])
def test_runs_equal_brute_force(periods):
    for x in some_texts(2, 400):
        assert periodic.runs(np.array(x, np.int64), periods) == brute(x, periods)


def test_the_cut_loses_no_run():
    rng = random.Random(3)
    for x in some_texts(4, 400):
        x = [rng.randint(10, 500) for _ in range(rng.randint(0, 300))] + x + [rng.randint(10, 60) for _ in range(200)]
        y = np.array(x, np.int64)
        assert {(s + a, n, q) for a, b in periodic.pieces(y) for s, n, q in periodic.runs(y[a:b])} == brute(x)


def test_hard_words():
    thue = [bin(i).count("1") % 2 for i in range(1024)]
    assert periodic.runs(np.array(thue, np.int64)) == set()
    a, b = [0], [0, 1]
    for _ in range(14):
        a, b = b, b + a
    assert periodic.runs(np.array(b, np.int64), 3) == brute(b, 3)
    assert periodic.runs(np.zeros(20_000, np.int64)) == {(0, 20_000, 1)}
    assert periodic.runs(np.arange(20_000) % 5_000) == {(0, 20_000, 5_000)}


def test_frames(spark, docs):
    rows = [(1, "x a b a b a b a b y"), (1, "x a b a b a b a b y"), (None, "z " * 6), (2, None), (3, ""), (4, " \t\n"), (5, "no run"),
            (6, "é  é \n" * 3), (7, "w w " * 40_000)]
    odd = docs(rows).withColumns({c: F.lit("x") for c in ("runs", "collapsed", "_words", "start")})
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(odd).collect()]
    assert got == [(1, [(1, 8, 2)], "x a b y")] * 2 + [(None, [(0, 6, 1)], "z"), (2, [], ""), (3, [], ""), (4, [], ""), (5, [], "no run"),
                                                       (6, [(0, 6, 1)], "é "), (7, [(0, 40_000, 1)], "w w")]
    assert periodic.periodic_runs(docs([])).count() == 0


def test_query_equals_plain_code(spark, small):
    def words(r):
        w = [] if r.text is None else r.text.encode().split()
        h = zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        return w

    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, small).collect()}
    rows = table(spark, small, "documents").collect()
    assert len(got) == len(rows)
    n_runs = 0
    for r in rows:
        w = words(r)
        codes = {c: i for i, c in enumerate(dict.fromkeys(w))}
        x = [codes[c] for c in w]
        if len(x) > 1500:                                   # too long for plain loops over all periods
            continue
        found = sorted(brute(x), key=lambda f: (f[0], f[2]))
        n_runs += len(found)
        out = got[r.doc_id]
        assert out.n_runs == len(found)
        best = min(found, key=lambda f: (-f[1], f[0], f[2]), default=(None, None, None))
        assert (out.start, out.length, out.period) == best
        assert out.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        kept = [c for i, c in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found)]
        assert out.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert out.collapsed_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()
    assert n_runs > 5
