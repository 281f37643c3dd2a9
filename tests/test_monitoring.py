from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lotvalue.operators.valuation import log_predictions, monitor
from lotvalue.streaming.monitoring import late_rows, monitor_stream, monitored

DAY0 = datetime(2024, 1, 1)
LOG = "id int, make_key string, prediction double, predicted_at timestamp"
SALES = "id int, price double, sold_at timestamp"


def logged(spark, ids):
    return spark.createDataFrame([(i, "ab"[i % 2], 100.0 + i, DAY0 + timedelta(days=i)) for i in ids], LOG)


def sold(spark, ids, after=3):
    return spark.createDataFrame([(i, 90.0 + i * 1.5, DAY0 + timedelta(days=i + after)) for i in ids], SALES)


@pytest.fixture
def run(spark, tmp_path):
    log, feed, out = (str(tmp_path / n) for n in ("log", "feed", "out"))

    def go():
        streams = (spark.readStream.schema(s).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(p)
                   for p, s in ((log, LOG), (feed, SALES)))
        query = monitor_stream(*streams, ["id"], ["make_key"], out, str(tmp_path / "cp"), horizon="30 days", delay="10 days")
        query.awaitTermination(300)
        return query
    return log, feed, out, go


def rows(df):
    return {r.make_key: pytest.approx((r.n, r.rmse, r.mape, r.r2)) for r in df.collect()}


def plain(df):
    return {r.make_key: (r.n, r.rmse, r.mape, r.r2) for r in df.collect()}


def test_stream_equals_batch_and_a_replay_changes_nothing(spark, run):
    log, feed, out, go = run
    log_predictions(logged(spark, range(40)).coalesce(1), log, "one")
    sold(spark, range(30)).coalesce(1).write.parquet(f"{feed}/1")
    go()
    want = monitor(logged(spark, range(40)), sold(spark, range(30)), ["id"], ["make_key"])
    assert plain(monitored(spark, out, ["make_key"])) == rows(want)
    log_predictions(logged(spark, range(40)).coalesce(1), log, "one")                 # the batch is logged again
    sold(spark, range(30, 40)).coalesce(1).write.parquet(f"{feed}/2")
    go()
    want = monitor(logged(spark, range(40)), sold(spark, range(40)), ["id"], ["make_key"])
    assert plain(monitored(spark, out, ["make_key"])) == rows(want)
    assert spark.read.parquet(log).count() == 40
    per_window = monitored(spark, out, ["make_key"], by_window=True)
    assert per_window.agg(F.sum("n")).first()[0] == 40 and per_window.select("window_start").distinct().count() > 1


def test_late_sales_and_sales_beyond_the_horizon(spark, run):
    log, feed, out, go = run
    log_predictions(logged(spark, [0, 1, 200]).coalesce(1), log, "one")
    sold(spark, [1, 200]).coalesce(1).write.parquet(f"{feed}/1")
    go()                                                                             # both streams are at day 200 by now
    sold(spark, [0]).coalesce(1).write.parquet(f"{feed}/2")                          # sold on day 3, reported after that
    sold(spark, [200], after=31).coalesce(1).write.parquet(f"{feed}/3")              # in time, but too long after the prediction
    query = go()
    assert late_rows(query) == 1
    assert monitored(spark, out, ["make_key"]).agg(F.sum("n")).first()[0] == 2
