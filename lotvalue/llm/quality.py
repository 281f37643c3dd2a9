"""Quality of documents by hierarchical empirical Bayes.

A logistic classifier on counts of a text gives its evidence: the log odds of good against bad beyond the base rate of the
labelled rows. Sites add what their other documents tell: each host's share of good documents is a posterior mean under a beta prior whose mean
and strength come from all hosts by moments, each path's one under a prior centred at its host. Sparse hosts so shrink to
the global share, sparse paths to their host. A document's log odds are those of its path, without the
document itself, plus its evidence. The posteriors are grouped sums; one row of moments and one weight per feature reach the driver.

The host is ``source``, the path below it ``lang`` (documents carry no address). Nulls are a host or path of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

#: Classes of bytes that are counted; a byte of none of them is of the class "rest".
CLASSES = {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "white": (9, 10, 11, 12, 13, 32),
           "point": b".,;:?", "mark": b"!", "bar": b"|", "sign": b"#$%&*+/<=>@\\^_{}~[]`", "beyond": range(128, 256)}
FEATURES = ["log_words", "word_bytes", *[f"{s}_{c}" for c in CLASSES for s in ("share", "root")],
            "distinct_words", "repeated_word", "distinct_lines", "line_bytes"]
KEEP = 0.5
_CLASS = np.full(256, len(CLASSES), np.uint8)
for _k, _bytes in enumerate(CLASSES.values()):
    _CLASS[list(_bytes)] = _k


def features(text: str | None) -> list[float]:
    """Numbers of one text, as named in FEATURES; all zero without a word."""
    data = (text or "").encode("utf-8")
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    lines = [x for x in data.split(b"\n") if x]
    share = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=len(CLASSES) + 1)[:len(CLASSES)] / len(data)
    both = np.stack([share, np.sqrt(share)], axis=1).ravel().tolist()
    repeated = sum(a == b for a, b in zip(words, words[1:])) / len(words)
    # The distinct share of words falls with length for any text; its exponent does not.
    spread = np.log1p(len(set(words))) / np.log1p(len(words))
    return [float(np.log1p(len(words))), len(data) / len(words), *both, float(spread), repeated,
            len(set(lines)) / len(lines), float(np.log1p(len(data) / len(lines)))]


def with_features(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` as _c0, _c1, ..., and _f (its features)."""
    at = docs.columns.index("text")
    source = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    schema = ", ".join(f"{c} {t}" for c, t in source.dtypes) + ", _f array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([features(t) for t in b.column(at).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, "_f"])

    return source.mapInArrow(run, schema)


def evidence(rows: DataFrame, labels: DataFrame) -> tuple[object, float]:
    """Fits on all labelled rows (doc_id, f): a column of log odds beyond the base rate, and the base rate.

    Labels of one class only (or none) say nothing: the evidence is zero, and the base rate what they are (one half).
    A document with several labels counts as good if most of them say so.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id") \
        .agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    train = store(rows.join(known, "doc_id").where("f[0] > 0").select("label", "f"), "quality_training")
    n, good = train.agg(F.count("*"), F.sum("label")).first()
    if not n or good in (0, n):
        return F.lit(0.0), (float(good) / n if n else 0.5)
    fit = LogisticRegression(featuresCol="v", labelCol="label", regParam=1e-4, maxIter=60) \
        .fit(train.select("label", array_to_vector("f").alias("v")))
    base = float(np.log(good / (n - good)))
    margin = F.lit(float(fit.intercept) - base)
    for i, w in enumerate(fit.coefficients.toArray().tolist()):
        margin = margin + F.get("f", F.lit(i)) * w
    return margin, good / n


def _strength(groups: DataFrame, mean) -> float:
    """Prior strength by moments: how many documents the spread of group means about ``mean`` is worth."""
    row = groups.where("n > 0").select("n", (F.col("s") / F.col("n")).alias("m"), mean.alias("c")).agg(
        F.avg(F.pow(F.col("m") - F.col("c"), 2)).alias("v"), F.avg(F.col("c") * (1 - F.col("c"))).alias("w"),
        F.avg(F.col("c") * (1 - F.col("c")) / F.col("n")).alias("noise")).first()
    if row.v is None:
        return 1.0
    return float(min(1e4, max(1.0, row.w / max(row.v - row.noise, 1e-9) - 1)))


def _odds(p):
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def site_posteriors(rows: DataFrame, base: float) -> tuple[DataFrame, float]:
    """rows (host, path, p) -> per host and path: n, s (sum of p), host_mean, host_n, host_s, host_k (strength of the host's prior); and
    the strength of a path's prior."""
    paths = store(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    k = _strength(hosts, F.lit(base))
    hosts = hosts.select(F.col("host").alias("_host"), ((k * base + F.col("s")) / (k + F.col("n"))).alias("host_mean"),
                         F.col("n").alias("host_n"), F.col("s").alias("host_s"), F.lit(k).alias("host_k"))
    told = store(paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host"), "site_posteriors")
    return told, _strength(told, F.col("host_mean"))


def _judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """with_features(docs) and _id, _evidence, _prior, _score."""
    names = docs.columns
    col = lambda c: F.col(f"_c{names.index(c)}")                                                # noqa: E731
    slim = store(with_features(docs.select("doc_id", "source", "lang", "text")).select(
        F.col("_c0").alias("doc_id"), F.col("_c1").alias("host"), F.col("_c2").alias("path"), F.col("_f").alias("f")),
        "quality_features")
    margin, base = evidence(slim.select("doc_id", "f"), labels)
    logit = float(np.log(max(base, 1e-6) / max(1 - base, 1e-6)))
    p = 1 / (1 + F.exp(-(margin + logit)))
    sites, k = site_posteriors(slim.where("f[0] > 0").select("host", "path", p.alias("p")), base)
    sites = sites.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "n", "s", "host_n", "host_s", "host_k")
    rows = with_features(docs).withColumn("f", F.col("_f")).withColumn("_evidence", margin)
    rows = rows.join(sites, col("source").eqNullSafe(F.col("_host")) & col("lang").eqNullSafe(F.col("_path")), "left")
    own = 1 / (1 + F.exp(-(F.col("_evidence") + logit)))
    host = (F.col("host_k") * base + F.col("host_s") - own) / (F.col("host_k") + F.col("host_n") - 1)     # without the document itself
    rows = rows.withColumn("_prior", F.coalesce((k * host + F.col("s") - own) / (k + F.col("n") - 1), F.lit(base)))
    score = 1 / (1 + F.exp(-(F.col("_evidence") + _odds(F.col("_prior")))))
    return rows.withColumn("_score", F.when(F.col("f")[0] > 0, score).otherwise(0.0))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, evidence, prior (of its path), score (0 to 1), keep.

    A text that is null or has no word scores 0. Rows with a null doc_id or repeated rows are judged like others;
    columns of other names are ignored. Texts are read whole; a score of exactly ``KEEP`` is kept. No rows give no rows.
    """
    rows = _judged(docs.select("doc_id", "text", "lang", "source"), labels)
    return rows.select(F.col("_c0").alias("doc_id"), F.col("_evidence").alias("evidence"), F.col("_prior").alias("prior"),
                       F.col("_score").alias("score"), (F.col("_score") >= KEEP).alias("keep"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score ``KEEP`` or more, with its columns, whatever their names. Nulls, ties and repeated rows as in ``judge``."""
    kept = _judged(docs, labels).where(F.col("_score") >= KEEP)
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
