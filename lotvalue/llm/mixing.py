"""Mixes sources to target weights by pivotal dependent rounding.

Every row of a source is wanted ``target / source size`` times. The whole part is taken; the fractional parts are
copy probabilities. Two of them are paired and mass, counted in words, moves from one to the other at random until one is 0 or 1, which
keeps every probability in expectation and the sum of words exactly. Rows of a source meet in chunks of bounded size, in order of
their size, so that mass moves between rows of like size; each chunk leaves one fractional row, and these meet in the next level of
a reduction tree until one row of the source is left, which is rounded alone. A source that holds a third of all rows is
many chunks. Smaller rows make good for the rounding of the last one: every chunk sends up, besides its fractional row, a reserve of
a few settled rows of each power of two of sizes. How near a source comes to its target thus depends on its own rows only. Masses are whole
numbers of 2**-30 words, so none is lost.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, pick, row_hash, store, WORD

CAP = 3
FAN = 4096
#: Rows a chunk holds in reserve, of each power of two of sizes: so many that are taken and so many that are not.
RESERVE = 2
ONE = 1 << 30


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """(source, size) -> one row per source: source_no, source, source_size, units, target.

    Sources in code point order, null last, take ``weights`` in turn. Each gets that share of all sizes, but at most
    ``cap`` times its own size; what is over is shared again by weight until no source is above. With the sources in the
    order of size by weight those at their cap come first, so a running sum finds them. The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    no = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("source_no", no).withColumn(
        "w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("source_no") % len(weights) + 1))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("w"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    total, full = F.sum("source_size").over(every).cast("double"), F.col("source_size").cast("double") * cap
    per = per.withColumn("full", full).withColumn("total", total).withColumn("all_w", F.sum("w").over(every))
    per = per.withColumn("below", F.coalesce(F.sum("full").over(before), F.lit(0.0))) \
        .withColumn("below_w", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("capped", F.col("full") * (F.col("all_w") - F.col("below_w"))
                         <= F.col("w") * (F.col("total") - F.col("below")))
    rest = F.col("total") - F.sum(F.when(F.col("capped"), F.col("full")).otherwise(0.0)).over(every)
    rest_w = F.sum(F.when(~F.col("capped"), F.col("w")).otherwise(0.0)).over(every)
    return per.withColumn("rest", rest).withColumn("rest_w", rest_w).select(
        "source_no", "source", "source_size", "rows",
        F.when(F.col("capped"), F.col("full")).otherwise(F.col("w") * F.col("rest") / F.col("rest_w")).alias("target"))


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs the fractional rows of one chunk; at most one stays fractional, none in the last chunk of a source."""
    pdf = pdf.sort_values(["size", "doc_id", "row"], kind="stable", na_position="last", ignore_index=True)
    size, p, none = pdf["size"].tolist(), pdf["p"].tolist(), -1
    full, free = [ONE * n for n in size], [i for i, (q, n) in enumerate(zip(p, size)) if 0 < q < ONE * n]
    reserve = free + np.flatnonzero(pdf["held"]).tolist()
    key = f"{pdf['source_no'].iat[0]} {pdf['chunk'].iat[0]} {pdf['level'].iat[0]}"
    rng, a = np.random.default_rng(xxhash.xxh64_intdigest(key, 42)), none
    for b, draw in zip(free, rng.random(len(free)).tolist()):
        if a == none:
            a = b
            continue
        up, down = min(full[a] - p[a], p[b]), min(p[a], full[b] - p[b])     # what may go from b to a, from a to b
        move = up if draw * (up + down) < down else -down
        p[a], p[b] = p[a] + move, p[b] - move
        a = a if 0 < p[a] < full[a] else b if 0 < p[b] < full[b] else none
    last = pdf["parts"].iat[0] == 1
    held = np.zeros(len(pdf), bool)
    # From the largest power of two down, in random order within each.
    order = sorted(rng.permutation(np.array(reserve, np.int64)).tolist(), key=lambda i: -size[i].bit_length())
    if last and a != none:
        over = -p[a]
        p[a] = full[a] if rng.random() * full[a] < p[a] else 0
        over += p[a]
        # The words that the last row gained or lost are made good by rows that are no larger than that.
        for i in order:
            if i != a and full[i] <= abs(over) and p[i] == (full[i] if over > 0 else 0):
                p[i] = full[i] - p[i]
                over += full[i] if p[i] else -full[i]
    elif not last:
        seen = Counter()
        for i in order:
            kind = size[i].bit_length(), p[i] > 0
            if i != a and seen[kind] < RESERVE:
                seen[kind] += 1
                held[i] = True
    return pdf.assign(p=p, held=held)


def copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, source, size, row) -> one row per distinct (source, doc_id, row) with n, copies; and the sources.

    n: equal rows; copies: how often they are taken altogether, ``CAP`` times n at most.
    """
    sources = store(source_targets(docs), "sources")
    units = docs.groupBy("source", "doc_id", "row", "size").agg(F.count("*").alias("n"))
    wanted = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("n")
    parts = F.ceil(F.col("rows") / FAN)
    units = (units.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
             .withColumn("wanted", wanted)
             .select("source_no", "doc_id", "row", "size", "n", F.floor("wanted").alias("whole"),
                     (F.round((F.col("wanted") - F.floor("wanted")) * ONE).cast("long") * F.col("size")).alias("p"),
                     F.pmod(F.xxhash64("doc_id", "row"), parts).alias("chunk"), F.lit(0).alias("level"),
                     parts.alias("parts"), F.lit(False).alias("held")))
    schema = ("source_no int, doc_id long, row long, size long, n long, whole long, p long, chunk long, level int, "
              "parts long, held boolean")
    most = sources.agg(F.max(F.ceil(F.col("rows") / FAN)).alias("m")).first().m or 1
    level, done = 0, None
    while True:
        settled = store(units.select(*[F.col(c.split()[0]) for c in schema.split(", ")])
                        .groupBy("source_no", "chunk").applyInPandas(_settle, schema), "settled")
        goes_on = F.col("held") | ((F.col("p") > 0) & (F.col("p") < F.col("size") * ONE))
        whole = settled.where(~goes_on)
        done = whole if done is None else done.unionByName(whole)
        if most == 1:
            break
        level, most = level + 1, -(-most // FAN)
        units = settled.where(goes_on).withColumn("chunk", F.floor(F.col("chunk") / FAN)) \
            .withColumn("parts", F.ceil(F.col("parts") / FAN)).withColumn("level", F.lit(level))
    return done.select("source_no", "doc_id", "row", "size", "n",
                       (F.col("whole") + (F.col("p") > 0).cast("long")).alias("copies")), sources


def _sized(docs: DataFrame, *more) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), *more)


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words taken, repeats counted).

    A null text or one without a word has size 0 and is not taken; a null source is a source of its own; rows with a
    null doc_id are mixed like others. Of equal rows (doc_id, source and size) the copies are dealt out evenly. Other columns are ignored.
    A text counts whole, however long. No rows give no rows.
    """
    taken, sources = copies(_sized(docs, F.lit(0).cast("long").alias("row")))
    each = taken.join(sources.select("source_no", "source_size", "target"), "source_no") \
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    times = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("i") < F.col("copies") % F.col("n"), 1).otherwise(0)
    return each.select("doc_id", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"))


@carried
def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns of ``docs``, whatever their names.

    Texts that are null or have no word are not taken. Rows equal in every column are dealt out together. No rows give no rows.
    """
    taken, _ = copies(_sized(docs, row_hash(docs).alias("row")))
    rows = pick(docs, taken.where("copies > 0"), "copies")
    return rows.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_x_copies")))).select(*docs.columns)
