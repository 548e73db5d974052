"""Sharding by extendible hashing.

A key's hash is read bit by bit. The directory starts with one bucket; a bucket above the
byte limit, and only such a one, splits on the next bit. All sizes come from one
histogram of hash prefixes a few bits finer than the expected shards, so the directory is
found without touching rows again; what is still too large there goes into another round
on its own. Keys whose own rows exceed the limit get overflow pages.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, sharing, written

#: Bits of the hash, the limit of a shard in bytes, and the finer bits of a round.
BITS = 60
LIMIT = 1 << 20
FINER = 4


def key_hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def split_round(rows: DataFrame, done: int, bits: int, limit: int) -> DataFrame:
    """Split the buckets of ``done`` bits down to ``bits``: rows of the directory.

    ``rows`` (hash, n_bytes). Returns fine (prefix of ``bits`` bits), depth, shard_bytes,
    shard_docs; depth is null where even ``bits`` bits leave more than the limit.
    """
    fine = rows.groupBy(F.shiftright("hash", BITS - bits).alias("fine")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"))
    level = fine.select(F.explode(F.sequence(F.lit(done), F.lit(bits))).alias("depth"), "fine", "bytes", "docs")
    nodes = level.groupBy("depth", F.expr(f"shiftright(fine, {bits} - depth)").alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"), F.col("shard_bytes").alias("above_bytes"))
    nodes = nodes.withColumn("above", F.shiftright("prefix", 1)).join(parents, ["depth", "above"], "left")
    split = F.coalesce(F.col("above_bytes") > limit, F.lit(True))
    fits = F.col("shard_bytes") <= limit
    leaves = nodes.filter(split & (fits | (F.col("depth") == bits)))
    span = F.expr(f"shiftleft(1L, {bits} - depth)")
    return leaves.select(F.explode(F.sequence(F.col("prefix") * span, F.col("prefix") * span + span - 1)).alias("fine"), F.when(fits, F.col("depth")).alias("depth"), "shard_bytes", "shard_docs")


def shards(spark: SparkSession, docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text", bits: int | None = None) -> DataFrame:
    """Give every row of ``docs`` a shard whose texts have ``limit`` bytes at most.

    Returns the key, n_bytes (UTF-8; null is 0), shard (bits of the hash prefix, and
    ``/page`` for overflow), depth, shard_bytes, shard_docs. A null key hashes like the
    empty text. Rows with one key stay together unless their texts alone exceed the limit;
    those fill pages of up to half the limit, and a larger text has a page of its own,
    the only kind of shard that can be above the limit. No rows give no rows.
    """
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes"), key_hash(F.col(key)).alias("hash"))
    rows = written(spark, slim.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    todo, done, parts = rows, 0, []
    to = bits or min(BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + FINER)
    while True:
        directory = written(spark, split_round(todo, done, to, limit), "shard-directory")
        placed = todo.withColumn("fine", F.shiftright("hash", BITS - to)).join(directory, "fine")
        digits = F.expr(f"substring(lpad(conv(shiftright(hash, {BITS - to}), 10, 2), {to}, '0'), 1, depth)")
        parts.append(placed.filter(F.col("depth").isNotNull()).select("key", "n_bytes", digits.alias("shard"), "depth", "shard_bytes", "shard_docs"))
        if directory.filter(F.col("depth").isNull()).limit(1).count() == 0:
            break
        todo = placed.filter(F.col("depth").isNull()).select("key", "n_bytes", "hash", "row")
        if to == BITS:
            parts.append(pages(todo, limit))
            break
        done, to = to, min(BITS, to + (bits or 8))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("key", key)


def pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of keys whose rows exceed the limit."""
    salts = sharing(rows.count(), least=16)
    frame = rows.withColumn("big", (F.col("n_bytes") > limit // 2).cast("int")).withColumn("one", F.lit(1).cast("long"))
    # Row numbers stand in a table, so a task that runs again deals the same pages.
    frame = frame.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    frame = numbered(frame, ["hash", "big"], ["row"], "part", {"before": "n_bytes", "ordinal": "one"})
    page = F.when(F.col("big") == 1, F.concat(F.lit("b"), F.col("ordinal").cast("string"))).otherwise(F.floor(F.col("before") / (limit // 2)).cast("string"))
    name = F.concat(F.expr(f"lpad(conv(hash, 10, 2), {BITS}, '0')"), F.lit("/"), page)
    frame = frame.select("key", "n_bytes", name.alias("shard"), F.lit(BITS).alias("depth"))
    sizes = frame.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return frame.join(sizes, "shard")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the rows of ``docs`` to a folder for each shard; keys are unique."""
    docs.join(placed.select(key, "shard"), key).repartition("shard").write.partitionBy("shard").parquet(path)
