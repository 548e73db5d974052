"""Adjacency graphs as text, one vertex a line: id, separator, vertex text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vertex import parse, render

SCHEMA = "key long, distance long, adjacencies array<long>"


def split_lines(lines: DataFrame, separator: str = "\t") -> DataFrame:
    """``lines`` (value) -> key and raw text; without a separator the text is empty."""
    at = F.instr("value", separator)
    key = F.when(at > 0, F.expr(f"substring(value, 1, instr(value, '{separator}') - 1)")).otherwise(F.col("value"))
    rest = F.when(at > 0, F.expr(f"substring(value, instr(value, '{separator}') + {len(separator)})")).otherwise(F.lit(""))
    return lines.select(key.cast("long").alias("key"), rest.alias("text"))


def read_raw(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    return split_lines(spark.read.text(path), separator)


def typed(raw: DataFrame) -> DataFrame:
    return raw.select("key", parse(F.col("text")).alias("v")).select("key", "v.distance", "v.adjacencies")


def read(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    return typed(read_raw(spark, path, separator))


def rendered(graph: DataFrame, separator: str = "\t") -> DataFrame:
    return graph.select(F.concat(F.col("key").cast("string"), F.lit(separator), render(F.col("distance"), F.col("adjacencies"))).alias("value"))


def write(graph: DataFrame, path: str, overwrite: bool = True, separator: str = "\t") -> None:
    rendered(graph, separator).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def edges(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("key").alias("src"), F.explode("adjacencies").alias("dst"))


def from_edges(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """A closed graph: every end of an edge is a vertex; ``seeds`` (key) have distance 0."""
    out = edges.groupBy(F.col("src").alias("key")).agg(F.sort_array(F.collect_list("dst")).alias("adjacencies"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("key")).union(seeds.select("key")).distinct()
    zero = seeds.select("key", F.lit(0).cast("long").alias("distance")).distinct()
    full = ends.join(out, "key", "left").join(zero, "key", "left")
    return full.select("key", "distance", F.coalesce("adjacencies", F.array().cast("array<bigint>")).alias("adjacencies"))


def add_missing(graph: DataFrame) -> DataFrame:
    """Rows for vertices that are only edge targets."""
    missing = edges(graph).select(F.col("dst").alias("key")).distinct().join(graph, "key", "left_anti")
    return graph.unionByName(missing.select("key", F.lit(None).cast("long").alias("distance"), F.array().cast("array<bigint>").alias("adjacencies")))


def mock(spark: SparkSession, n: int = 100) -> DataFrame:
    """The fixture source: rows (i, i)."""
    return spark.range(n).select(F.col("id").alias("key"), F.col("id").alias("value"))
