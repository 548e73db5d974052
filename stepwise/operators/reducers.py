"""Reducers written in Python, for what column expressions can't say."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.intervals import validity


def temporal_reduce(merged: DataFrame, reducer: Callable[[int, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Call ``reducer(key, versions)`` for each key with its versions and their intervals."""

    def run(key: tuple[object, ...], frame: pd.DataFrame) -> pd.DataFrame:
        return reducer(key[0], frame.sort_values("step", kind="stable"))

    return validity(merged).groupBy("key").applyInPandas(run, schema)


def split_reduce(previous: DataFrame, current: DataFrame, reducer: Callable[[int, pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Call ``reducer(key, previous, current)`` for each key that either side holds."""

    def run(key: tuple[object, ...], before: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
        return reducer(key[0], before, now)

    return previous.groupBy("key").cogroup(current.groupBy("key")).applyInPandas(run, schema)
