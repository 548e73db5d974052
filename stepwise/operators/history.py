"""Every version that each key has emitted, by step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intervals import validity


class History:
    """Rows (key, step, values): step 0 is the input, step k what iteration k - 1 emitted."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    @classmethod
    def start(cls, initial: DataFrame) -> History:
        return cls(initial.withColumn("step", F.lit(0)))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> History:
        """From Parquet partitioned by step: reading a range of steps skips the other files."""
        return cls(spark.read.parquet(path).withColumn("step", F.col("step").cast("int")))

    def save(self, path: str, overwrite: bool = True) -> None:
        self.rows.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("step").parquet(path)

    def append(self, delta: DataFrame, step: int) -> History:
        return History(self.rows.unionByName(delta.withColumn("step", F.lit(step))))

    def at(self, step: int) -> DataFrame:
        return self.rows.filter(F.col("step") == step)

    def between(self, first: int, last: int) -> DataFrame:
        return self.rows.filter(F.col("step").between(first, last))

    def since(self, checkpoint: int) -> DataFrame:
        """Versions after a checkpoint, which holds all up to its own step."""
        return self.rows.filter(F.col("step") > checkpoint)

    def where(self, steps: Callable | None) -> DataFrame:
        """Versions of the steps that a predicate on the step column chooses."""
        return self.rows.filter(steps(F.col("step"))) if steps else self.rows

    def intervals(self, tie: list[str] | None = None) -> DataFrame:
        return validity(self.rows, tie=tie)

    def compacted(self, summarize: Callable[[DataFrame], DataFrame], checkpoint: int) -> History:
        """Versions up to a checkpoint as one row a key, at step 0; later ones as they are."""
        summary = summarize(self.rows.filter(F.col("step") <= checkpoint)).withColumn("step", F.lit(0))
        return History(summary.unionByName(self.since(checkpoint)))
