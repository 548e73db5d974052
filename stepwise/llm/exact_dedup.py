"""Exact deduplication by content-defined chunk recipes.

A text is cut where a rolling hash of its last 16 bytes has ten zero bits, so equal
stretches of text give equal chunks wherever they stand. A chunk's identifier is a digest
that is *verified*: every distinct chunk content of the corpus is held against its digest
once, after each task has dropped the repeats it has seen; if two contents ever share a
digest, the next wider digest is taken and verified in turn. From then on only recipes,
the ordered identifier lists, move: two texts are equal when their recipes are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_blocks, with_groups, written

SMALLEST, LARGEST = 256, 8192
ZERO_BITS = 10
WINDOW = 16
#: Tried in this order; each is used only if no two chunks of the corpus share one.
DIGESTS = ("xxh3_128", "blake2b_256", "sha512")


def digest(kind: str):
    """The function that identifies a chunk. ``xxh3_<bits>`` may be narrowed for tests."""
    if kind.startswith("xxh3_"):
        size = int(kind.removeprefix("xxh3_")) // 8
        return lambda chunk: xxhash.xxh3_128_digest(chunk)[:size]
    if kind == "blake2b_256":
        return lambda chunk: hashlib.blake2b(chunk, digest_size=32).digest()
    return lambda chunk: hashlib.sha512(chunk).digest()


def cut_points(data: np.ndarray, starts: np.ndarray) -> list[list[int]]:
    """For each text in ``data``, the ends of its chunks; empty for an empty text."""
    table = np.random.default_rng(20_000).integers(0, 1 << 32, 256, dtype=np.uint32)
    rolled = table[data]
    reach = 1
    while reach < WINDOW:
        rolled[reach:] = rolled[reach:] + (rolled[:-reach] << np.uint32(reach))
        reach *= 2
    marks = np.flatnonzero(rolled >> np.uint32(32 - ZERO_BITS) == 0) + 1
    out = []
    at = np.searchsorted(marks, starts).tolist()
    bounds = starts.tolist()
    for i in range(len(bounds) - 1):
        begin, end = bounds[i], bounds[i + 1]
        ends: list[int] = []
        for mark in [*marks[at[i] : at[i + 1]].tolist(), end]:
            while mark - begin > LARGEST:
                begin += LARGEST
                ends.append(begin)
            if mark - begin >= SMALLEST and mark < end:
                begin = mark
                ends.append(begin)
        if end > begin:
            ends.append(end)
        out.append(ends)
    return out


def chunks(kind: str):
    """A mapInArrow function: texts -> the chunks that this block of rows holds, each once."""

    def run(batches):
        name = digest(kind)
        for batch in batches:
            for _, _, data, starts in text_blocks(batch.column(0)):
                raw = data.tobytes()
                seen: dict[tuple[bytes, bytes], None] = {}
                for begin, ends in zip(starts.tolist(), cut_points(data, starts), strict=False):
                    for end in ends:
                        chunk = raw[begin:end]
                        seen[name(chunk), chunk] = None
                        begin = end
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in seen], pa.binary()), pa.array([x[1] for x in seen], pa.binary())], ["id", "content"])

    return run


def recipes(kind: str):
    """A mapInArrow function: (doc_id, text) -> (doc_id, recipe, SHA-256 of the text)."""

    def run(batches):
        name = digest(kind)
        for batch in batches:
            for lo, hi, data, starts in text_blocks(batch.column(1)):
                raw = data.tobytes()
                lists, sums = [], []
                for begin, stop, ends in zip(starts.tolist(), starts.tolist()[1:], cut_points(data, starts), strict=False):
                    sums.append(hashlib.sha256(raw[begin:stop]).hexdigest())
                    own = []
                    for end in ends:
                        own.append(name(raw[begin:end]))
                        begin = end
                    lists.append(b"".join(own))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(lists, pa.binary()), pa.array(sums, pa.string())], ["doc_id", "recipe", "text_sha256"])

    return run


def verified_digest(docs: DataFrame, kinds: tuple[str, ...] = DIGESTS) -> str:
    """The first digest under which all distinct chunks of ``docs`` differ."""
    for kind in kinds:
        # Map-side, each task drops the repeats it has seen, so a chunk that a third of
        # all documents share arrives once from each task.
        distinct = docs.select(F.col("text").cast("string")).mapInArrow(chunks(kind), "id binary, content binary").distinct()
        if not distinct.groupBy("id").count().filter("count > 1").limit(1).count():
            return kind
    raise ValueError(f"two chunks share a digest under each of {', '.join(kinds)}")


def verified_key(made: DataFrame, sizes: tuple[int, ...] = (256, 512)) -> DataFrame:
    """Adds ``key``, a digest of the recipe under which all distinct recipes differ.

    Recipes of long texts are long themselves, so they are identified as chunks are: by a
    digest that is held against all distinct recipes once.
    """
    distinct = made.select("recipe").distinct()
    for size in sizes:
        if not distinct.groupBy(F.sha2("recipe", size).alias("key")).count().filter("count > 1").limit(1).count():
            return made.withColumn("key", F.sha2("recipe", size))
    raise ValueError("two recipes share a digest")


def exact_copies(spark: SparkSession, docs: DataFrame, kinds: tuple[str, ...] = DIGESTS) -> DataFrame:
    """Group equal texts of ``docs`` (doc_id, text) and choose one row of each group.

    Returns a row per input row: doc_id, keep_id, group_size, kept, text_sha256. Null
    texts count as empty, and empty texts are equal. The row with the largest doc_id
    stays; null ids are the smallest, and of rows that repeat the largest id any one
    stays. An empty table gives an empty result; other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = verified_digest(slim, kinds)
    made = slim.mapInArrow(recipes(kind), "doc_id long, recipe binary, text_sha256 string")
    made = written(spark, made.withColumn("row", F.monotonically_increasing_id()), "recipes")
    made = verified_key(made).drop("recipe")
    groups = made.groupBy("key").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count("*").alias("group_size"))
    joined = with_groups(made, written(spark, groups, "groups"), "key", "group_size")
    return joined.select("doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "text_sha256")


def without_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_copies`` keeps, with all their columns.

    Of rows that repeat both id and text one stays, whichever. Null texts are empty ones,
    a null id is an id of its own and the smallest. No rows give no rows. Columns of
    ``docs`` are returned as they are; their names can't clash.
    """
    known = lambda x: (x.isNull().alias("unnamed"), F.coalesce(x, F.lit(0).cast("long")).alias("id"))
    marks = exact_copies(spark, docs).filter("kept").select(*known(F.col("doc_id")), F.col("text_sha256").alias("sum"))
    rows = docs.select(*known(F.col("doc_id").cast("long")), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("sum"), F.struct("*").alias("row"))
    keys = ["unnamed", "id", "sum"]
    return rows.join(marks, keys, "left_semi").dropDuplicates(keys).select("row.*")
