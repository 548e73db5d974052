"""What the corpus operators share: text blocks and row numbers."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.storage import temporaries, written  # noqa: F401


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, across tasks."""
    holder = sys.modules.setdefault("_worker_cache_", types.ModuleType("_worker_cache_"))
    return holder.__dict__.setdefault(name, {})


def text_blocks(column: pa.Array, most: int = 2 << 20, rows: int = 4096):
    """Cut a string column into runs of whole rows with about ``most`` bytes, ``rows`` rows at most.

    Yields (first row, end row, UTF-8 bytes, row starts); null counts as empty.
    A text longer than ``most`` is a block of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n, lo + rows)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def sharing(rows: int, per_task: int = 20_000, least: int = 16) -> int:
    """How many salts deal ``rows`` rows of one key out in tasks of bounded size."""
    return max(least, -(-rows // per_task))


def with_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], count: str, parts: int = 1000) -> DataFrame:
    """Join ``rows`` with ``groups``, a written table of one row for each ``key``.

    ``count`` is the number of rows with the key, so fewer than ``parts`` keys can hold
    more than one of ``parts`` equal shares of all. They are broadcast, and their rows
    stay where they are; all others are shuffled. Keys are short: numbers or digests. Rows
    with a null key are dropped.
    """
    total, most = groups.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0))).first()
    if most * parts <= total:
        return rows.join(groups, key)
    often = F.col(count) * parts > total
    spread = F.broadcast(groups.filter(often))
    rest = rows.join(F.broadcast(groups.filter(often).select(key)), key, "left_anti")
    return rows.join(spread, key).unionByName(rest.join(groups.filter(~often), key))


def numbered(frame: DataFrame, key: list[str], order: list, salt: str, sums: dict[str, str]) -> DataFrame:
    """Running sums within ``key`` without bringing a key's rows into one task.

    ``salt`` is an integer column that deals each key's rows into parts; parts follow
    each other in its order. ``sums`` maps an output column to the summed long column:
    the output holds the sum over all rows of the key before this one. Key and salt are
    not null; window and join share one exchange.
    """
    parts = frame.groupBy(*key, salt).agg(*[F.sum(c).alias(f"{o}__part") for o, c in sums.items()])
    before = Window.partitionBy(*key).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*key, salt, *[F.coalesce(F.sum(f"{o}__part").over(before), F.lit(0)).alias(f"{o}__base") for o in sums])
    inside = Window.partitionBy(*key, salt).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = frame.withColumns({f"{o}__in": F.coalesce(F.sum(c).over(inside), F.lit(0)) for o, c in sums.items()})
    joined = summed.join(parts, [*key, salt], "left")
    return joined.withColumns({o: F.col(f"{o}__in") + F.col(f"{o}__base") for o in sums}).drop(*[f"{o}__{x}" for o in sums for x in ("in", "base")])
