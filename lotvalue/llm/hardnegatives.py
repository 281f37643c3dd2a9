"""Hard negatives by Four-Russians scoring.

Components become whole numbers, and a vector the bit planes of its components: one byte holds one bit of eight components. For
an anchor, eight components make a table of the sums of all their 256 subsets. The product of an anchor and a candidate is then
read off: the candidate's bytes index the tables, and the sums found for a plane are added to twice those of the planes above it
(the top plane is that of the sign and counts negatively). Every score is the full, exact product.

Rows are dealt evenly to shards by a hash, anchors to chunks; each shard meets each chunk in one group of bounded size, as bit planes
of some bytes per component. First the anchors meet rows of a like hash of the label, which gives their positives; then, with the
scores of these, all rows. From each group go the first few per anchor and positive only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store
from .vectors import dealt, matrix, parts

SHARD = 16384
CHUNK = 8192
LABELS = 16             # hash values of labels; a hot one is spread over shards like all others
SCALE = 256
ANCHORS, ROWS = 128, 2048
POSITIVES = NEGATIVES = 5
#: Percent of the positive's score that a negative has at least.
FLOOR = 80
_LONG = np.iinfo(np.int64)


def whole(column, width: int, exact: bool) -> np.ndarray:
    """floor(SCALE * x) of every component; as Python's numbers, which have no limit, where ``exact`` asks for it."""
    x = matrix(column, width)
    if not exact:
        return np.floor(x * SCALE).astype(np.int64)
    out = np.empty(x.shape, object)
    for at, v in np.ndenumerate(x):                         # a number of 2^53 and more is whole already
        out[at] = int(np.floor(v * SCALE)) if abs(v) < 2.0 ** 53 else int(v) * SCALE
    return out


def pack(x: np.ndarray, bits: int) -> np.ndarray:
    """rows x components -> rows x planes x bytes, in two's complement, the lowest plane first."""
    n, width = x.shape
    padded = np.zeros((n, -(-width // 8) * 8), x.dtype)
    padded[:, :width] = x
    out = np.empty((n, bits, padded.shape[1] // 8), np.uint8)
    for b in range(bits):
        out[:, b] = np.packbits(((padded >> b) & 1).astype(np.uint8), axis=1, bitorder="little")
    return out


def unpack(planes: np.ndarray, kind) -> np.ndarray:
    """The whole numbers again."""
    bit = np.unpackbits(planes, axis=2, bitorder="little").astype(kind)
    out = -bit[:, -1]
    for b in range(planes.shape[1] - 2, -1, -1):
        out = out * 2 + bit[:, b]
    return out


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """anchors x components -> groups x 256 x anchors: the sum of each subset of eight components."""
    n, width = anchors.shape
    out = np.zeros((width // 8, 256, n), anchors.dtype)
    for g in range(width // 8):
        for j in range(8):
            out[g, 1 << j:2 << j] = out[g, :1 << j] + anchors[:, g * 8 + j]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """anchors x rows: lookups added per plane, planes shifted together from the sign down."""
    total = np.zeros((len(planes), tables.shape[2]), tables.dtype)
    found = np.empty_like(total)
    for b in range(planes.shape[1] - 1, -1, -1):
        total += total
        for g in range(len(tables)):
            np.take(tables[g], planes[:, b, g], axis=0, out=found, mode="clip")
            total = total - found if b == planes.shape[1] - 1 else np.add(total, found, out=total)
    if total.dtype == object:
        total = np.clip(total, _LONG.min + 1, _LONG.max)
    return total.T.astype(np.int64, copy=False)


def first(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of the ``k`` highest allowed scores of each line, ties to the smaller column; in that order."""
    score = np.where(allowed, score, _LONG.min)
    low = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), _LONG.min)
    line, col = np.nonzero(allowed & (score >= low[:, None]))
    order = np.lexsort((col, -score[line, col], line))
    line, col = line[order], col[order]
    keep = np.arange(len(line)) - np.searchsorted(line, np.arange(len(score)))[line] < k
    return line[keep], col[keep]


class Scorer:
    """How vectors are stored as bit planes, and scored."""

    def __init__(self, width: int, top: float):
        self.groups = max(1, -(-width // 8))
        self.bits = (int(top) * SCALE + SCALE).bit_length() + 1
        limit = self.groups * 8 << 2 * self.bits            # above any score and any sum on the way to it
        self.kind = np.int32 if limit < 1 << 31 else np.int64 if limit < 1 << 63 else object

    def planes(self, column) -> np.ndarray:
        return np.frombuffer(b"".join(column), np.uint8).reshape(-1, self.bits, self.groups)

    def blocks(self, own: pd.DataFrame, anchors: pd.DataFrame) -> Iterator[tuple]:
        """(from, to) in ``anchors``, (from, to) in ``own``, scores of these."""
        rows, asked = self.planes(own["planes"]), self.planes(anchors["planes"])
        for a in range(0, len(asked), ANCHORS):
            tables = subset_sums(unpack(asked[a:a + ANCHORS], self.kind))
            for r in range(0, len(rows), ROWS):
                yield slice(a, a + ANCHORS), slice(r, r + ROWS), scores(tables, rows[r:r + ROWS])


def _met(rows: DataFrame, anchors: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def pair(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(asked):
            found = run(own.sort_values("vec_id", ignore_index=True), asked)
        if not found:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
        return pd.DataFrame(np.concatenate(found, axis=1).T, columns=names)

    return rows.groupBy(*keys).cogroup(anchors.groupBy(*keys)).applyInPandas(pair, schema)


def _chosen(found: list[np.ndarray], keys: int, k: int) -> list[np.ndarray]:
    """Of columns (``keys`` of them, id, score) the first ``k`` per key."""
    if not found:
        return []
    x = np.concatenate(found, axis=1)
    x = x[:, np.lexsort((x[keys], -x[keys + 1], *x[:keys]))]
    new = np.r_[True, (x[:keys, 1:] != x[:keys, :-1]).any(axis=0)]
    at = np.flatnonzero(new)
    return [x[:, np.arange(x.shape[1]) - at[np.cumsum(new) - 1] < k]]


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
         floor: int = FLOOR) -> DataFrame:
    """vectors (vec_id, embedding, label: a whole number) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(256 x), a score is the whole-numbered inner product. Anchors are the rows whose vec_id is
    divisible by ``every``. An anchor's positives are the first ``positives`` other rows of its label; for each of these the first
    ``negatives`` rows of other labels follow that score from ``floor`` percent of the positive's score up to all of it.
    First is the higher score, then the smaller vec_id.

    Rows with a null label, a null vector, or a null or non-finite component take no part; shorter vectors count as ending in
    zeros. A null vec_id is no anchor and comes after all others in ties (the largest long stands for it on the way). A repeated vec_id is a row of
    its own, as anchor, positive and negative. Scores beyond a long count as the largest or smallest long. An empty table, and anchors without
    positives or negatives, give no rows. Other columns are ignored.
    """
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    good = vectors.select("vec_id", "embedding", F.col("label").alias("label")) \
        .where("embedding is not null and label is not null").where(~bad)
    width, top = good.agg(F.max(F.size("embedding")), F.max(F.array_max(F.transform(x, lambda e: F.abs(e.cast("double")))))).first()
    scorer = Scorer(width or 0, top or 0.0)
    exact = scorer.bits > 62

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in frames:
            planes = pack(whole(own["embedding"], scorer.groups * 8, exact), scorer.bits)
            yield own.drop(columns="embedding").assign(planes=[p.tobytes() for p in planes])

    kept = good.select(F.monotonically_increasing_id().alias("row"), F.coalesce("vec_id", F.lit(int(_LONG.max))).alias("vec_id"),
                       F.col("label").cast("long").alias("label"), "embedding")
    rows = store(kept.mapInPandas(packed, "row long, vec_id long, label long, planes binary"), "bit_planes")
    is_anchor = (F.col("vec_id") % every == 0) & (F.col("vec_id") < int(_LONG.max))
    n, asked = rows.agg(F.count("*"), F.count_if(is_anchor)).first()

    def spread(col: str, n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(col)

    # Rows of one hash of the label: a sixteenth of a large shard as a rule, all of it for a hot label.
    chunks, shards = parts(asked, CHUNK), parts(n, 4 * SHARD)
    group = dealt("label", LABELS).alias("group")
    own = rows.select("*", group, dealt("row", shards).alias("shard"))
    anchors = rows.where(is_anchor)

    def near(own, asked):
        found, label, ids, at = [], own["label"].to_numpy(), own["vec_id"].to_numpy(), own["row"].to_numpy()
        asked_row, asked_label = asked["row"].to_numpy(), asked["label"].to_numpy()
        for a, r, s in scorer.blocks(own, asked):
            fits = (asked_label[a, None] == label[r]) & (asked_row[a, None] != at[r])
            line, col = first(s, fits, positives)
            found.append(np.stack([asked_row[a][line], ids[r][col], s[line, col]]))
        return _chosen(found, 1, positives)

    known = _met(own.select("*", spread("chunk", chunks)),
                 anchors.select("*", group, dealt("row", chunks).alias("chunk")).select("*", spread("shard", shards)),
                 ["group", "shard", "chunk"], near, "row long, vec_id long, score long")
    known = _ranked(known, ["row"], positives).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives"))
    ready = store(anchors.join(known.hint("merge"), "row").select(
        "row", F.col("vec_id").alias("anchor_id"), "label", "planes", F.col("positives.vec_id").alias("ids"),
        F.col("positives.score").alias("positive_scores")), "anchors")

    def hard(own, asked):
        found, label, ids = [], own["label"].to_numpy(), own["vec_id"].to_numpy()
        asked_row, asked_label = asked["row"].to_numpy(), asked["label"].to_numpy()
        limits = [[int(p) for p in own] for own in asked["positive_scores"]]
        for a, r, s in scorer.blocks(own, asked):
            other = asked_label[a, None] != label[r]
            for j in range(positives):
                at = np.array([i for i, p in enumerate(limits[a]) if len(p) > j], np.int64)
                if not len(at):
                    break
                high = [limits[a][i][j] for i in at]
                low = [-(-floor * p // 100) for p in high]  # 100 s >= floor p, in whole numbers
                low = np.array([min(v, int(_LONG.max)) for v in low], np.int64)[:, None]
                fits = other[at] & (s[at] <= np.array(high, np.int64)[:, None]) & (s[at] >= low)
                line, col = first(s[at], fits, negatives)
                found.append(np.stack([asked_row[a][at[line]], np.full(len(line), j), ids[r][col], s[at[line], col]]))
        return _chosen(found, 2, negatives)

    shards = parts(n, SHARD)
    found = _met(rows.withColumn("shard", dealt("row", shards)).select("*", spread("chunk", chunks)),
                 ready.withColumn("chunk", dealt("row", chunks)).select("*", spread("shard", shards)),
                 ["shard", "chunk"], hard, "row long, j long, vec_id long, score long")
    best = _ranked(found, ["row", "j"], negatives)

    def id_of(c) -> Column:
        return F.nullif(c, F.lit(int(_LONG.max)))

    place = F.col("j").cast("int")
    return best.hint("merge").join(ready.select("row", "anchor_id", "ids", "positive_scores"), "row").select(
        "anchor_id", id_of(F.get("ids", place)).alias("positive_id"), "rank", id_of(F.col("vec_id")).alias("negative_id"),
        F.get("positive_scores", place).alias("positive_score"), F.col("score").alias("negative_score"))
