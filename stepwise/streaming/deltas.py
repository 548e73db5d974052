"""A stream of changes as history: every micro-batch is a step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_steps(stream: DataFrame, path: str, checkpoint: str, first: int = 1) -> StreamingQuery:
    """Write each micro-batch to its step's folder; a batch that runs again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/step={first + number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
