"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_state = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    In local mode, where one machine runs everything, a temporary folder is made if none is
    named. On a cluster that is an error, since executors would not see each other's files.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set {SETTING} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="stepwise-")
        spark.conf.set(SETTING, folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")


def file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The Hadoop file system of a path, and the path as it knows it."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    system, there = file_system(spark, path)
    return system.exists(there)


def removed(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder with all below it; was there one?"""
    system, there = file_system(spark, path)
    return system.delete(there, True)


def own_folder(spark: SparkSession) -> str:
    """A folder of this application in the shared one; it is deleted when the application ends."""
    path = f"{shared_folder(spark)}/stepwise-{spark.sparkContext.applicationId}"
    if path not in getattr(_state, "made", set()):
        system, there = file_system(spark, path)
        system.mkdirs(there)
        system.deleteOnExit(there)
        _state.made = getattr(_state, "made", set()) | {path}
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path for a new table; inside ``temporaries`` it is deleted at the end."""
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_state, "open", None):
        _state.open[-1].append(path)
    return path


def written(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it: cuts the lineage, computes once.

    Unlike ``checkpoint()`` the plan runs once only, and the files outlive executors. They
    are deleted with the enclosing ``temporaries``, else when the application ends.
    """
    return table(spark, frame, fresh_path(spark, name))


def table(spark: SparkSession, frame: DataFrame, path: str) -> DataFrame:
    frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete the tables that are written inside, when the block ends.

    Yields ``written`` for results that outlive the block (they belong to the next outer
    one). What else the block returns must not read its tables any more.
    """
    if not hasattr(_state, "open"):
        _state.open = []
    outer = _state.open[-1] if _state.open else None
    mine: list[str] = []
    _state.open.append(mine)

    def keep(frame: DataFrame, name: str) -> DataFrame:
        path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
        if outer is not None:
            outer.append(path)
        return table(spark, frame, path)

    try:
        yield keep
    finally:
        _state.open.remove(mine)
        for path in mine:
            removed(spark, path)
