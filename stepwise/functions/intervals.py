"""Validity intervals [valid_from, valid_to) over step numbers; a null end is unbounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def validity(history: DataFrame, key: str = "key", step: str = "step", tie: list[str] | None = None) -> DataFrame:
    """Adds valid_from, valid_to and is_current: a version is valid until the key's next one.

    Versions of one step get empty intervals but for the last, in the order of ``tie``.
    """
    order = Window.partitionBy(key).orderBy(step, *(tie or []))
    # The start is named above the window: a projection below it would hide that a union of
    # bucketed tables is dealt by key.
    ended = history.withColumn("valid_to", F.lead(step).over(order))
    return ended.select(*history.columns, F.col(step).alias("valid_from"), "valid_to", F.col("valid_to").isNull().alias("is_current"))


def contains(step: Column | int) -> Column:
    """Is a step inside the row's interval?"""
    step = step if isinstance(step, Column) else F.lit(step)
    return (F.col("valid_from") <= step) & (F.col("valid_to").isNull() | (step < F.col("valid_to")))


def as_of(intervals: DataFrame, step: int) -> DataFrame:
    return intervals.filter(contains(step))


def size() -> Column:
    """Steps in the interval; null if unbounded."""
    return F.col("valid_to") - F.col("valid_from")


def text() -> Column:
    return F.concat(F.lit("["), F.col("valid_from").cast("string"), F.lit(", "), F.coalesce(F.col("valid_to").cast("string"), F.lit("inf")), F.lit(")"))


def tupled(value: Column) -> Column:
    """A value with its interval, as one struct."""
    return F.struct(value.alias("value"), "valid_from", "valid_to")


def pairs(history: DataFrame, value: str, key: str = "key", step: str = "step", name: str = "following") -> DataFrame:
    """Each version with the value of its key's next one; null after the last."""
    return history.withColumn(name, F.lead(value).over(Window.partitionBy(key).orderBy(step)))


def split(history: DataFrame, now: int, step: str = "step") -> tuple[DataFrame, DataFrame]:
    """Versions from before a step, and those of the step itself."""
    return history.filter(F.col(step) < now), history.filter(F.col(step) == now)


def first_last(history: DataFrame, value: str, key: str = "key", step: str = "step") -> DataFrame:
    """The first and the last value of each key."""
    return history.groupBy(key).agg(F.min_by(value, step).alias("first_value"), F.max_by(value, step).alias("last_value"))


def normalized(history: DataFrame, values: list[str], key: str = "key", step: str = "step") -> DataFrame:
    """Temporal normal form: drop versions equal to the key's version before."""
    order = Window.partitionBy(key).orderBy(step)
    now = F.struct(*values)
    before = F.lag(now).over(order)
    first = F.row_number().over(order) == 1
    return history.withColumn("_same", ~first & before.eqNullSafe(now)).filter(~F.col("_same")).drop("_same")
