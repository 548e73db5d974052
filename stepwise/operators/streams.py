"""Ordered streams of key and value: merges with and without their origin, and groups."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written


def merge(*streams: DataFrame, order: list[str] | None = None) -> DataFrame:
    """All rows; sorted by ``order`` within partitions that hold whole keys."""
    out = reduce(DataFrame.unionByName, streams)
    return out.repartition(order[0]).sortWithinPartitions(*order) if order else out


def merge_sorted(*streams: DataFrame, order: list[str]) -> DataFrame:
    """All rows in one order: ranges of it over partitions, sorted in each."""
    return reduce(DataFrame.unionByName, streams).repartitionByRange(*order).sortWithinPartitions(*order)


def placed(merged: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Numbers the rows of a merge in its order, from 0, without bringing them into one task.

    Rows that are equal in ``order`` are numbered in any order among themselves.
    """
    kept = written(merged.sparkSession, merged.withColumn("_range", F.spark_partition_id()), "placed")
    sizes = kept.groupBy("_range").agg(F.count("*").alias("_size"))
    # One row for each partition.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return kept.withColumn("_inside", inside).join(starts, "_range").withColumn(name, F.col("_start") + F.col("_inside")).drop("_range", "_inside", "_start")


def compared(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as the first key comes before, with or after the second."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def merge_with_index(*streams: DataFrame, name: str = "step") -> DataFrame:
    """All rows with the number of the stream they come from."""
    return reduce(DataFrame.unionByName, [s.withColumn(name, F.lit(i)) for i, s in enumerate(streams)])


def merge_mapped(selector: Callable[[DataFrame], DataFrame], *streams: DataFrame) -> DataFrame:
    return selector(merge(*streams))


def group_by_key(stream: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """Exactly one group for each key."""
    return stream.groupBy(key).agg(*aggregates)


def group_identity(stream: DataFrame, value: str) -> DataFrame:
    """Groups of equal values and their sizes."""
    return stream.groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def partition_of(key: Column, n: int) -> Column:
    """Modulo partitioner; never negative."""
    return F.pmod(key, F.lit(n)).cast("int")


def partitioned(frame: DataFrame, key: str, n: int) -> DataFrame:
    return frame.repartitionById(n, partition_of(F.col(key), n))
