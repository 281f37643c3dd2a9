"""Accuracy of logged predictions as sales come in: a join of two streams, and metrics that merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery


def matched_sales(predictions: DataFrame, sales: DataFrame, on: list[str], horizon: str = "90 days", delay: str = "7 days") -> DataFrame:
    """Each sale with the predictions made for it at most ``horizon`` before: two streams, joined under watermarks.

    ``predictions`` holds ``on`` and predicted_at, ``sales`` holds ``on``, sold_at and price (timestamps). A prediction that
    comes again, from a batch logged twice, counts once. State is kept for ``horizon`` and ``delay`` only; what is later than that is
    dropped, and counted by ``late_rows``.
    """
    logged = predictions.withWatermark("predicted_at", delay).dropDuplicatesWithinWatermark([*on, "predicted_at"])
    sold = sales.select(*[F.col(c).alias(f"_{c}") for c in on], "sold_at", "price").withWatermark("sold_at", delay)
    same = F.lit(True)
    for c in on:
        same = same & (F.col(c) == F.col(f"_{c}"))
    in_time = (F.col("sold_at") >= F.col("predicted_at")) & (F.col("sold_at") <= F.col("predicted_at") + F.expr(f"INTERVAL {horizon}"))
    return sold.join(logged, same & in_time).drop(*[f"_{c}" for c in on])


def window_sums(matched: DataFrame, keys: list[str], window: str = "30 days") -> DataFrame:
    """Per window of sale time and ``keys``: n, mean and squared deviations of the price, and sums of errors; these merge."""
    e = F.col("price") - F.col("prediction")
    return matched.groupBy(F.window("sold_at", window)["start"].alias("window_start"), *keys).agg(
        F.count("*").alias("n"), F.avg("price").alias("mean"), (F.var_pop("price") * F.count("price")).alias("m2"),
        F.sum(e * e).alias("squared"), F.sum(F.try_divide(F.abs(e), F.abs("price"))).alias("relative"))


def monitor_stream(predictions: DataFrame, sales: DataFrame, on: list[str], keys: list[str], out_path: str, checkpoint_path: str,
                   horizon: str = "90 days", delay: str = "7 days", window: str = "30 days", **trigger) -> StreamingQuery:
    """Writes the sums of every micro-batch to its own folder, so that a batch replayed after a failure replaces its own."""
    def write(batch: DataFrame, batch_id: int) -> None:
        window_sums(batch, keys, window).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    return (matched_sales(predictions, sales, on, horizon, delay).writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint_path).trigger(**(trigger or {"availableNow": True})).start())


def monitored(spark: SparkSession, out_path: str, keys: list[str], by_window: bool = False) -> DataFrame:
    """n, RMSE, MAPE (in percent) and R2 per ``keys`` (and window) over all micro-batches so far."""
    group = (["window_start"] if by_window else []) + keys
    own = Window.partitionBy(*group)
    sums = spark.read.parquet(out_path)
    weighed = sums.withColumn("all", F.sum(F.col("n") * F.col("mean")).over(own) / F.sum("n").over(own))

    def total(c) -> Column:
        return F.sum(c)

    spread = total(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("all"), 2))
    return weighed.groupBy(*group).agg(
        total("n").alias("n"), F.sqrt(total("squared") / total("n")).alias("rmse"),
        (total("relative") / total("n") * 100).alias("mape"), (1 - F.try_divide(total("squared"), spread)).alias("r2"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, over the query's recent batches."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
