"""Outputs of a job's steps, as tables that a later step or a restarted job reads.

Tables are dealt and sorted by key into a fixed number of buckets, so a step that merges
them with messages moves the messages alone. A table counts once it is written whole: what
a lost run has left unfinished is written again.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .storage import exists, file_system, fresh_path

CHECKPOINTS = "checkpoints"


def step_path(step: int, steps: int, source: str, output: str, folder: str, name: str) -> str:
    """Where step ``step`` reads, and the one before it writes: the source, a step's own place, the output."""
    if step == 0:
        return source
    return output if step == steps else f"{folder.rstrip('/')}/{name}/step-{step}"


def step_files(spark: SparkSession, folder: str) -> DataFrame:
    """(step, path) of the data files of a job's steps; checkpoints, which lie beside them, are none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select("path")
    below = re.sub(r"^[a-z0-9]+:(//[^/]*)?", "", folder.rstrip("/"))
    own = files.filter(~F.col("path").contains(f"{below}/{CHECKPOINTS}/"))
    return own.select(F.regexp_extract("path", r"/step-([0-9]+)/", 1).cast("int").alias("step"), "path")


@contextmanager
def dealt_plans(spark: SparkSession, partitions: int) -> Iterator[None]:
    """Plans made and run inside use so many partitions, and read buckets as they are dealt."""
    wanted = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Steps:
    """The tables (key, values, step) of one job: step 0 is the input, step k what iteration k - 1 emitted."""

    #: A checkpoint can be read in the step that writes it, before that step has an output.
    reads_own_checkpoint = True

    def __init__(self, spark: SparkSession, schema: StructType, partitions: int, key: str = "key", folder: str | None = None):
        if "step" in schema.names:
            raise ValueError("the column step is the store's own")
        self.spark, self.key, self.partitions = spark, key, partitions
        self.schema = StructType(list(schema.fields)).add("step", IntegerType())
        self.folder = f"{(folder or fresh_path(spark, 'steps')).rstrip('/')}/buckets-{partitions}"
        self.names: list[str] = []
        self.known: dict[str, str] = {}

    def path(self, step: int, checkpoint: bool = False) -> str:
        return f"{self.folder}/{CHECKPOINTS + '/' if checkpoint else ''}step-{step}"

    def has(self, step: int, checkpoint: bool = False) -> bool:
        """Is the table there, and whole?"""
        return exists(self.spark, f"{self.path(step, checkpoint)}/_SUCCESS")

    def last(self) -> int | None:
        """The last step up to which every output is there."""
        step = 0
        while self.has(step):
            step += 1
        return step - 1 if step else None

    def listed(self, checkpoints: bool = False) -> list[int]:
        """The steps that have an output, or a checkpoint."""
        system, there = file_system(self.spark, f"{self.folder}/{CHECKPOINTS}" if checkpoints else self.folder)
        names = [x.getPath().getName() for x in system.listStatus(there)] if system.exists(there) else []
        return sorted(int(n.removeprefix("step-")) for n in names if re.fullmatch("step-[0-9]+", n) and self.has(int(n.removeprefix("step-")), checkpoints))

    def dealt(self, frame: DataFrame, step: int) -> DataFrame:
        """Rows of a step as its table holds them, dealt by key; columns that ``frame`` lacks are null."""
        columns = [F.lit(step).alias("step") if f.name == "step" else (F.col(f.name) if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]
        # All columns are made before the exchange, so that a union with tables keeps the dealing.
        return frame.select(*columns).repartition(self.partitions, self.key)

    def write(self, frame: DataFrame, step: int, checkpoint: bool = False) -> DataFrame:
        path, name = self.path(step, checkpoint), f"stepwise_{uuid.uuid4().hex}"
        writer = self.dealt(frame, 0 if checkpoint else step).write.format("parquet").mode("overwrite").option("path", path).option("compression", "zstd")
        writer.bucketBy(self.partitions, self.key).sortBy(self.key).saveAsTable(name)
        self.names.append(name)
        self.known[path] = name
        return self.read(step, checkpoint)

    def read(self, step: int, checkpoint: bool = False) -> DataFrame:
        """One table: in its buckets for plans made inside ``dealt_plans``, else as plain files."""
        path = self.path(step, checkpoint)
        if self.spark.conf.get("spark.sql.sources.bucketing.autoBucketedScan.enabled") != "false":
            return self.spark.read.schema(self.schema).parquet(path)
        if path not in self.known:
            name = f"stepwise_{uuid.uuid4().hex}"
            place = path.replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} ({self.schema.toDDL()}) USING parquet CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.partitions} BUCKETS LOCATION '{place}'")
            self.names.append(name)
            self.known[path] = name
        # The filter is always true. It stands between scan and union, since a union of column
        # batches doesn't bring its inputs' buckets together, while one of rows does.
        return self.spark.table(self.known[path]).filter(F.col("step") >= 0)

    def between(self, first: int, last: int) -> DataFrame:
        """Versions of a range of steps, each from its own table."""
        return reduce(DataFrame.unionByName, [self.read(k) for k in range(first, last + 1)])

    def history(self, step: int, checkpoint: int | None = None) -> DataFrame:
        """Versions up to a step; those that a checkpoint holds come from it, as step 0."""
        if checkpoint is None:
            return self.between(0, step)
        summary = self.read(checkpoint, checkpoint=True)
        return summary if checkpoint >= step else summary.unionByName(self.between(checkpoint + 1, step))

    def forget(self) -> None:
        """Drop the tables' names; the files stay."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names, self.known = [], {}
