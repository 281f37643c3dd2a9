import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from lotvalue.operators.quantiles import group_medians, group_quantiles

PROBS = [0.0, 0.25, 0.5, 0.9, 1.0]


def expected(pdf, probs):
    kept = pdf.dropna()
    return {k: [float(np.quantile(g.v, p)) for p in probs] for k, g in kept.groupby("k")}


def check(spark, pdf, max_values):
    df = spark.createDataFrame(list(pdf.itertuples(index=False)), "k string, v double")
    df = df.withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    out = group_quantiles(df, ["k"], {"v": F.col("v")}, PROBS, max_values=max_values).collect()
    want = expected(pdf, PROBS)
    assert {r.k for r in out} == set(want)
    for r in out:
        assert np.allclose([r[f"q{i}"] for i in range(len(PROBS))], want[r.k])
        assert r.n_values == pdf.dropna()[pdf.dropna().k == r.k].shape[0]


def test_both_ways_with_a_hot_group(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": np.where(rng.random(4000) < 0.6, "hot", rng.integers(0, 30, 4000).astype(str)),
                        "v": np.round(rng.normal(0, 50, 4000), 1)})
    pdf.loc[::97, "v"] = np.nan
    check(spark, pdf, max_values=10**6)
    check(spark, pdf, max_values=5)       # forces the range-sorted way


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(-5, 5)), min_size=1, max_size=60))
def test_range_sorted_way_on_any_ties(spark, pairs):
    check(spark, pd.DataFrame([(k, float(v)) for k, v in pairs], columns=["k", "v"]), max_values=0)


def test_medians_without_keys_and_with_missing_keys(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, 5.0), (None, 100.0, 7.0)], "k string, x double, y double")
    whole = group_medians(df, [], {"mx": F.col("x"), "my": F.col("y")}).first()
    assert (whole.mx, whole.my) == (3.0, 6.0)
    by_key = group_medians(df, ["k"], {"mx": F.col("x")}).collect()
    assert [tuple(r) for r in by_key] == [("a", 2.0)]
