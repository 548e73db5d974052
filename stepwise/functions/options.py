"""Optional values as nulls: extremes that ignore the undefined, and small tuple helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

min_option = F.min
max_option = F.max


def pair_min(a: Column, b: Column) -> Column:
    return F.least(a, b)


def pair_max(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def min_by(value: str, by: list[str]) -> Column:
    """The value of the row with the smallest ``by``, ties broken by the later columns."""
    return F.min_by(F.col(value), F.struct(*by))


def max_by(value: str, by: list[str]) -> Column:
    return F.max_by(F.col(value), F.struct(*by))


def has_multiple() -> Column:
    return F.count(F.lit(1)) > 1


def has_single() -> Column:
    return F.count(F.lit(1)) == 1


def defined(frame: DataFrame, value: str) -> DataFrame:
    """The rows whose value is defined."""
    return frame.filter(F.col(value).isNotNull())


def pair_sequence(a: Column, b: Column) -> Column:
    return F.array(a, b)


def pair_flatten(a: Column, b: Column) -> Column:
    """The defined values of a pair of optional ones."""
    return F.filter(F.array(a, b), lambda x: x.isNotNull())
