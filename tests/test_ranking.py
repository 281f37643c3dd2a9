import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotvalue.operators.ranking import (
    apply_cuts, positional_rank, rolling_trend, split_cuts, split_fractions, time_split,
)

START = dt.datetime(2020, 1, 1)


def lots(spark, n, days=7, hot=0.5, seed=0):
    rng = np.random.default_rng(seed)
    day = np.where(rng.random(n) < hot, 3, rng.integers(0, days, n))       # day 3 holds most of the lots
    return spark.createDataFrame(
        [(int(i), START + dt.timedelta(days=int(d)), "k" if i % 3 else None, float(i % 11)) for i, d in enumerate(day)],
        "id long, sold_date timestamp_ntz, key string, price double")


@pytest.mark.parametrize("n, sizes", [(90, (62, 14, 14)), (2576, (1803, 386, 387)), (3482, (2437, 522, 523)),
                                      (1, (0, 0, 1)), (2, (1, 0, 1))])
def test_split_sizes(spark, n, sizes):
    out = time_split(lots(spark, n), "sold_date", ["id"])
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert tuple(counts.get(s, 0) for s in ("train", "val", "test")) == sizes
    assert out.count() == n


def test_split_cut_uses_double_arithmetic():
    before_val, before_test = split_fractions(0.15, 0.15)
    assert int(90 * before_val) == 62 and int(90 * before_test) == 76


def test_split_follows_rank(spark):
    df = lots(spark, 200)
    bucket = F.pmod(F.col("id"), F.lit(4))
    ranks = positional_rank(df, "sold_date", ["id"], bucket=bucket)
    split = time_split(df, "sold_date", ["id"], bucket=bucket).select("id", "split")
    cuts = split_cuts(df, "sold_date", ["id"], bucket=bucket).first()
    fetched = apply_cuts(df, cuts, "sold_date", ["id"], bucket).select("id", "split")
    assert fetched.exceptAll(split).isEmpty() and split.exceptAll(fetched).isEmpty()
    rows = ranks.join(split, "id").orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, 201))
    assert [r["split"] for r in rows] == ["train"] * 140 + ["val"] * 30 + ["test"] * 30
    order = [(r.sold_date, r.id % 4, r.id) for r in rows]
    assert order == sorted(order)


def test_missing_dates_come_last(spark):
    df = lots(spark, 20).withColumn("sold_date", F.when(F.col("id") != 5, F.col("sold_date")))
    last = positional_rank(df, "sold_date", ["id"]).orderBy(F.desc("position")).first()
    assert last.id == 5 and last.position == 20


def brute_trend(pdf, include_current):
    pdf = pdf.sort_values(["sold_date", "b", "id"])
    source = pdf.price if include_current else pdf.price.shift(1)
    mean = source.rolling(6, min_periods=1).mean()
    return dict(zip(pdf.id, zip(mean, mean - mean.shift(6))))


@pytest.mark.parametrize("include_current", [True, False])
def test_rolling_blocks_match_one_long_window(spark, include_current):
    df = lots(spark, 300).withColumn("b", F.pmod(F.col("id"), F.lit(8)))
    out = rolling_trend(df, "key", "sold_date", ["id"], "price", include_current=include_current,
                        bucket=F.col("b"), block_rows=17)
    got = {r.id: (r.rolling_mean, r.momentum) for r in out.collect()}
    assert len(got) == 300
    pdf = pd.DataFrame([r.asDict() for r in df.collect()])
    want = brute_trend(pdf[pdf.key.notna()], include_current)
    for key, pair in want.items():
        for a, b in zip(got[key], pair):
            assert (a is None and np.isnan(b)) or a == pytest.approx(b)
    assert all(got[i] == (None, None) for i in range(0, 300, 3))


def test_block_must_hold_the_look_back(spark):
    with pytest.raises(ValueError):
        rolling_trend(lots(spark, 5), "key", "sold_date", ["id"], "price", block_rows=5)
