"""Files by whatever file system Spark reaches."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.storage import exists, file_system  # noqa: F401


def scheme(spark: SparkSession, path: str) -> str:
    """The file system that a path belongs to."""
    return file_system(spark, path)[0].getUri().getScheme()


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The files below a path, at any depth."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a file, or of all files of a folder in no order."""
    return spark.read.text(path)


def fetch(spark: SparkSession, path: str, local: str | None = None, name: str | None = None) -> Iterator[str]:
    """Stream a file's lines to the driver, a partition at a time.

    With ``local`` they are first copied to a file in that folder of the driver, by the
    name given or the path's own; a copy that is there already is not made again.
    """
    if local is None:
        yield from (row.value for row in lines(spark, path).toLocalIterator())
        return
    copy = Path(local) / (name or path.rstrip("/").rsplit("/", 1)[-1])
    if not copy.exists():
        with copy.open("w", encoding="utf-8") as out:
            out.writelines(f"{line}\n" for line in fetch(spark, path))
    with copy.open(encoding="utf-8", newline="\n") as kept:
        for line in kept:
            yield line.removesuffix("\n")


def put(frame: DataFrame, path: str, overwrite: bool = True) -> None:
    frame.write.mode("overwrite" if overwrite else "errorifexists").text(path)


def upload(spark: SparkSession, local: str, path: str, overwrite: bool = True) -> None:
    """Copy a file of the driver to a path."""
    system, there = file_system(spark, path)
    system.copyFromLocalFile(False, overwrite, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(local), there)
