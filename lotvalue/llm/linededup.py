"""Near-duplicate lines by a segment-partition edit join, in DataFrame operations only.

A line of ``MIN_BYTES`` UTF-8 bytes or more is a near-duplicate of another within ``TAU`` = 2 byte edits. Each distinct line
is split into ``TAU + 1`` segments; of two lines within ``TAU`` edits, the longer one holds a segment of the shorter one
unchanged, near its old place. So every line is indexed under (its length, segment number, segment), and probes, for each length
from its own down to ``TAU`` less, the few substrings that can be that segment: a start may be off by no more edits
than can come before it, and leave no more than can come after it. Where many lines
share a key, as copies with one word changed do, only pairs whose byte counts are near enough come out of the
join. Pairs that share a key are deduplicated and verified: equal
heads and tails are cut off, and the rest goes through a banded bit-parallel edit distance, whose band of ``2 * TAU + 1``
cells is one word.

Of equal and near-duplicate lines the first stays (by doc_id, null last, then row hash, then place): a line goes if it is not the
first of its text or if a line within ``TAU`` edits comes before it, kept or not. Shorter lines stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, release, row_hash, store

TAU = 2
MIN_BYTES = 32
#: Equal heads and tails are cut off in steps of so many bytes.
CHUNK = 16
#: Under a key with more lines than this, pairs are made only where byte counts allow them to be near.
HOT = 16
_BAND = 2 * TAU + 1
_ALL = (1 << _BAND) - 1


def _start(n: Column, i: int) -> Column:
    """Offset (from 0) of segment ``i`` of a line of ``n`` bytes; the last ones take the remainder."""
    parts = TAU + 1
    return (F.floor(n / parts) * i + F.greatest(F.lit(0), n % parts - (parts - i))).cast("int")


def _segment(line: Column, start: Column, length: Column) -> Column:
    return line.substr(start + 1, length)


def index_keys(line: Column, n: Column) -> Column:
    keys = [F.xxhash64(n, F.lit(i), _segment(line, _start(n, i), _start(n, i + 1) - _start(n, i)))
            for i in range(TAU + 1)]
    return F.array(*keys)


def probe_keys(line: Column, n: Column) -> Column:
    keys = []
    for less in range(TAU + 1):
        short = n - less
        for i in range(TAU + 1):
            for shift in range(max(-i, less - (TAU - i)), min(i, less + (TAU - i)) + 1):
                start = _start(short, i)
                keys.append(F.xxhash64(short, F.lit(i),
                                       _segment(line, start + shift, _start(short, i + 1) - start)))
    return F.array(*keys)


def _common(a: Column, b: Column, n: Column, from_end: bool) -> Column:
    """How many whole chunks of two lines of at least ``n`` bytes agree from one end on."""
    def chunk(x, k):
        at = (F.length(x) - (k + 1) * CHUNK if from_end else k * CHUNK) + 1
        return x.substr(at.cast("int"), F.lit(CHUNK))
    chunks = F.sequence(F.lit(0), F.floor(n / CHUNK).cast("int"))
    unequal = F.filter(chunks, lambda k: ((k + 1) * CHUNK > n) | (chunk(a, k) != chunk(b, k)))
    return F.get(unequal, F.lit(0)) * CHUNK


def within(a: Column, b: Column) -> Column:
    """Whether two byte strings, ``a`` the longer by at most ``TAU``, are within ``TAU`` edits.

    Hyyrö's bit-parallel recurrence over the diagonal band: bit ``TAU + d`` of a word is row ``j + d`` of column j.
    """
    m, n = F.length(a), F.length(b)

    def same(i):                                        # match bits of column i: a[i - TAU .. i + TAU] against b[i]
        bits = [F.when((i + d >= 0) & (a.substr((i + d + 1).cast("int"), F.lit(1)) == b.substr(i + 1, F.lit(1))),
                       1 << (TAU + d)).otherwise(0) for d in range(-TAU, TAU + 1)]
        total = bits[0]
        for x in bits[1:]:
            total = total.bitwiseOR(x)
        return total

    def step(s, i):
        # Nested structs stand in for local variables; each is computed once.
        def words(x):
            vp, vn = s["vp"], s["vn"]
            d0 = ((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(_ALL)
            return F.struct(d0.alias("d0"))

        def rest(w):
            vp, vn, d0 = s["vp"], s["vn"], w["d0"]
            hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(_ALL))
            hn = d0.bitwiseAND(vp)
            down = F.shiftright(d0, 1)
            diagonal = i < m - TAU
            at = (F.lit(_BAND - 2) - (i - (m - TAU))).cast("int")
            hit = lambda h: F.when(F.shiftright(h, 1).bitwiseAND(F.lit(1)) >= 0,       # noqa: E731
                                   F.floor(h / F.pow(F.lit(2), at)).cast("int").bitwiseAND(1)).otherwise(0)
            gain = F.when(diagonal, 1 - F.shiftright(d0, _BAND - 1)).otherwise(hit(hp) - hit(hn))
            return F.struct(
                hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(_ALL)).alias("vp"),
                down.bitwiseAND(hp).alias("vn"), (s["score"] + gain).alias("score"))

        first = F.transform(F.array(same(i)), words)
        return F.get(F.transform(first, rest), F.lit(0))

    start = F.struct(F.lit(_ALL & (_ALL << (_BAND - TAU - 1))).alias("vp"), F.lit(0).alias("vn"), F.lit(TAU).alias("score"))
    score = F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: s["score"])
    plain = F.when(n == 0, m <= TAU).when(m <= TAU, _levenshtein(a, b) <= TAU)
    return plain.otherwise(score <= TAU)


def _levenshtein(a: Column, b: Column) -> Column:
    """For rests no longer than the band: as text of one character a byte."""
    return F.levenshtein(F.decode(a, "ISO-8859-1"), F.decode(b, "ISO-8859-1"))


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, row, pos, line (binary): the lines long enough."""
    lines = docs.select("doc_id", row_hash(docs).alias("row"),
                        F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("doc_id", "row", "pos", F.col("line").cast("binary").alias("line")) \
        .where(F.length("line") >= MIN_BYTES)


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "pos")


def distinct_lines(docs: DataFrame) -> DataFrame:
    """id (hash of the bytes), line, first (where it stands first)."""
    return (occurrences(docs).select(F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("id2"), "line",
                                     _place().alias("at"))
            .groupBy("id", "id2").agg(F.any_value("line").alias("line"), F.min("at").alias("first")))


def _counts(line: Column) -> Column:
    """Of each of 16 classes of bytes (by their last four bits) the number in a line, modulo 16, in four bits."""
    text, packed = F.decode(line, "ISO-8859-1"), F.lit(0).cast("long")
    for k in range(16):
        others = F.translate(text, "".join(chr(16 * h + k) for h in range(16)), "")
        packed = packed.bitwiseOR(F.shiftleft(((F.length(text) - F.length(others)) % 16).cast("long"), 4 * k))
    return packed


def _apart(x: Column, y: Column) -> Column:
    """A lower bound for twice the edit distance: an edit changes two of the counts by one."""
    total = F.lit(0)
    for k in range(16):
        d = F.shiftright(x, 4 * k).bitwiseAND(15) - F.shiftright(y, 4 * k).bitwiseAND(15)
        total = total + F.least(F.pmod(d, F.lit(16)), F.pmod(-d, F.lit(16)))
    return total


def _of_hot_keys(met: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a key under which more than ``HOT`` lines are indexed, and may be near by their byte counts.

    Such a key is met by one marker, so its rows are one per probing line; every indexed line also probes its own keys.
    """
    n = F.length("line")
    rows = met.select("a", "key").distinct().join(lines.select(F.col("id").alias("a"), "line"), "a").select(
        "a", "key", _counts(F.col("line")).alias("counts"), F.array_contains(index_keys(F.col("line"), n), F.col("key")).alias("own"))
    rows = store(rows, "hot_line_keys")
    held = rows.where("own").select("key", F.col("a").alias("b"), F.col("counts").alias("with"))
    return rows.join(held, (rows.key == held.key) & (F.col("a") != F.col("b"))
                     & (_apart(F.col("counts"), F.col("with")) <= 2 * TAU)).select("a", "b")


def links(lines: DataFrame) -> DataFrame:
    """Verified pairs (a, b) of ids of different lines within ``TAU`` edits, a > b."""
    n = F.length("line")
    same = Window.partitionBy("key")
    index = lines.select(F.col("id").alias("b"), F.explode(index_keys(F.col("line"), n)).alias("key"))
    index = index.withColumn("n", F.count("*").over(same)).withColumn("first", F.min("b").over(same)) \
        .where(f"n <= {HOT} or b = first").select("key", F.when(F.col("n") <= HOT, F.col("b")).alias("b"))
    probe = lines.select(F.col("id").alias("a"), F.explode(probe_keys(F.col("line"), n)).alias("key"))
    met = probe.join(index.hint("shuffle_hash"), "key").where("b is null or a <> b") \
        .select("a", "b", F.when(F.col("b").isNull(), F.col("key")).alias("key"))
    met = store(met, "line_keys")
    release(lines.sparkSession)
    # Only lines that met another go on: their text is moved once here, and what is moved below is theirs alone.
    known = met.where("b is not null").select(F.col("b").alias("id")).unionByName(met.select(F.col("a").alias("id"))).distinct()
    lines = store(lines.select("id", "line").hint("merge").join(known, "id", "left_semi"), "met_lines")
    release(lines.sparkSession)
    pairs = met.where("b is not null").select("a", "b").unionByName(_of_hot_keys(met.where("b is null"), lines))
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = store(pairs, "line_pairs")
    release(lines.sparkSession)
    text = lines.select("id", "line").hint("merge")
    held = (pairs.join(text.withColumnsRenamed({"id": "a", "line": "ta"}), "a")
            .join(text.withColumnsRenamed({"id": "b", "line": "tb"}), "b"))
    swap = F.length("ta") < F.length("tb")
    held = held.select("a", "b", F.when(swap, F.col("tb")).otherwise(F.col("ta")).alias("la"),
                       F.when(swap, F.col("ta")).otherwise(F.col("tb")).alias("lb"))
    head = _common(F.col("la"), F.col("lb"), F.length("lb"), False)
    tail = F.least(_common(F.col("la"), F.col("lb"), F.length("lb"), True), F.length("lb") - F.col("head"))
    held = held.withColumn("head", head).withColumn("tail", tail).select(
        "a", "b", *[F.expr(f"substring({x}, head + 1, length({x}) - head - tail)").alias(x) for x in ("la", "lb")])
    # Stored, as a lambda would otherwise compute the rests anew for every byte.
    held = store(held, "line_rests")
    return held.where(within(F.col("la"), F.col("lb"))).select("a", "b")


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` with such lines: doc_id, row, gone (places of the lines that go), n_links of its lines."""
    spark = docs.sparkSession
    lines = store(distinct_lines(docs), "lines")
    release(spark)
    found = store(links(lines.select("id", "line")), "line_links")
    release(spark)
    first = lines.select("id", "first")
    ends = found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = ends.join(first.withColumnRenamed("id", "b"), "b").groupBy("a").agg(
        F.min("first").alias("before"), F.count("*").alias("links"))
    told = first.join(other, first.id == other.a, "left").select(
        "id", "first", F.coalesce("links", F.lit(0)).alias("links"),
        (F.col("before").isNotNull() & (F.col("before") < F.col("first"))).alias("later"))
    told = store(told, "line_fates")
    at = occurrences(docs).select(F.xxhash64("line").alias("id"), "doc_id", "row", "pos", _place().alias("at"))
    # No line text travels here; the side with one row per distinct line is stored, so hot lines can be split.
    fate = at.join(told, "id").select(
        "doc_id", "row", "pos", "links", ((F.col("at") != F.col("first")) | F.col("later")).alias("goes"))
    per = fate.where("goes or links > 0").groupBy("doc_id", "row").agg(
        F.collect_list(F.when(F.col("goes"), F.col("pos"))).alias("gone"), F.sum("links").alias("n_links"))
    return store(per, "line_decisions")


def _without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """``docs`` with its lines that stay as _kept, and the numbers of what went."""
    right = decided.hint("merge").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"),
                           F.col("gone").alias("_went"), F.col("n_links").alias("_links"))
    held = docs.withColumn("_key", row_hash(docs)).join(
        right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_row")), "left")
    return held.withColumn("_gone", F.array_distinct(F.coalesce("_went", F.expr("cast(array() as array<int>)")))) \
        .withColumn("_lines", F.split("text", "\n", -1))


_KEPT = "array_join(filter(_lines, (x, i) -> not array_contains(_gone, i)), '\n')"


def dedup_lines(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, n_links, text (its lines that stay).

    n_links: links of its lines to different lines within ``TAU`` edits. A null text stays null, with no lines; a text that
    loses all its lines becomes empty; rows with a null doc_id come last. Rows equal in every column hold the same lines at the
    same places: what goes from one goes from all of them. Other columns are ignored except to tell rows apart.
    Lines of any length are compared whole. No rows give no rows.
    """
    return _without(docs, deduplicated(docs)).select(
        "doc_id", F.greatest(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.size("_gone").cast("long").alias("n_removed"),
        F.coalesce("_links", F.lit(0)).alias("n_links"), F.expr(_KEPT).alias("text"))


@carried
def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines that stay, under the same columns; n_chars, where there is one, follows the text.

    Nulls, empty and repeated rows as in ``dedup_lines``; further columns stay as they are, whatever their names. No rows give no rows.
    """
    held = _without(docs, deduplicated(docs)).withColumn("_kept", F.expr(_KEPT))
    new = {"text": F.col("_kept"), "n_chars": F.when(F.size("_gone") > 0, F.length("_kept").cast("long"))
           .otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return held.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                  unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
d AS (SELECT line, min(struct_pack(d := doc_id, p := pos)) AS f FROM l WHERE strlen(line) >= {MIN_BYTES} GROUP BY line),
k AS (SELECT a.line AS x, b.line AS y, b.f AS g FROM d AS a
      JOIN d AS b ON strlen(b.line) BETWEEN strlen(a.line) - {TAU} AND strlen(a.line) + {TAU} AND a.line <> b.line
      WHERE (contains(b.line, substr(a.line, 1, length(a.line) // 3))
             OR contains(b.line, substr(a.line, length(a.line) // 3 + 1, length(a.line) // 3))
             OR contains(b.line, substr(a.line, length(a.line) // 3 * 2 + 1)))
        AND levenshtein(a.line, b.line) <= {TAU}),
t AS (SELECT d.line, d.f, coalesce(min(k.g) < d.f, false) AS later, count(k.y) AS links
      FROM d LEFT JOIN k ON k.x = d.line GROUP BY d.line, d.f),
fate AS (SELECT l.*, t.links, t.f IS NOT NULL AND (t.later OR t.f <> struct_pack(d := doc_id, p := pos)) AS goes
         FROM l LEFT JOIN t USING (line))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_removed,
       CAST(coalesce(sum(links), 0) AS BIGINT) AS n_links,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '') AS text
FROM fate GROUP BY doc_id"""
