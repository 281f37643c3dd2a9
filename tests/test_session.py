import os

from pyspark.sql import functions as F

from lotvalue.operators.ranking import time_split
from lotvalue.session import materialize, run_dir, scratch
from lotvalue.streaming.scoring import score_stream


def folders(spark):
    path = run_dir(spark).removeprefix("file:")
    return set(os.listdir(path)) if os.path.isdir(path) else set()


def test_tables_of_a_block_go_with_it(spark):
    before = folders(spark)
    with scratch(spark):
        assert materialize(spark.range(5), "t").count() == 5
        assert len(folders(spark) - before) == 1
    assert folders(spark) == before


def test_finished_stream_leaves_no_table(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "in"))
    before = folders(spark)
    feed = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    score_stream(feed, lambda b: materialize(b, "scored"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
    assert folders(spark) == before


def test_time_split_scans_lots_three_times(spark, tmp_path, monkeypatch):
    from lotvalue.operators import ranking
    plans = []

    def kept(df, label, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, label, **options)
    monkeypatch.setattr(ranking, "materialize", kept)
    spark.range(100).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"), "id") \
        .write.parquet(str(tmp_path / "lots"))
    lots = spark.read.parquet(str(tmp_path / "lots"))
    out = time_split(lots, "d", ["id"])
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    scans = sum(line.count("FileScan parquet") for p in plans for line in p.splitlines() if f"{tmp_path}/lots" in line)
    assert scans <= 4        # the counts need two, as days and their buckets are counted from the same rows
    assert {r.split: r.n for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 70, "val": 15, "test": 15}
