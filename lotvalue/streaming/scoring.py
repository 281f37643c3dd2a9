"""Scoring a feed of valuation requests. Scoring is stateless, so each micro-batch is an ordinary batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..session import scratch


def score_stream(requests: DataFrame, score: Callable[[DataFrame], DataFrame], out_path: str,
                 checkpoint_path: str, **trigger) -> StreamingQuery:
    """Runs ``score`` on each micro-batch. A batch replayed after a failure overwrites its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):       # the tables of a finished batch go
            score(batch).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    return (requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_path)
            .trigger(**(trigger or {"availableNow": True})).start())
