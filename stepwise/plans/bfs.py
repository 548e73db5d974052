"""Breadth-first search over adjacency graphs (key, distance, adjacencies) in three ways.

Seeds have distance 0. Graphs are closed (every edge target is a vertex) and keys unique;
``check`` says so, ``add_missing`` closes a graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.checkpoints import Never
from ..operators.storage import temporaries, written
from ..sources.adjacency import add_missing as closed
from .iterate import StepContext, iterate, schimmy_iterate, temporal_iterate


def empty():
    return F.array().cast("array<bigint>")


def check(graph: DataFrame) -> None:
    """Raise an error if keys repeat, edges dangle, or a seed isn't at 0."""
    if graph.groupBy("key").count().filter("count > 1").limit(1).count():
        raise ValueError("vertex keys repeat")
    if graph.filter("distance != 0").limit(1).count():
        raise ValueError("seeds must have distance 0")
    ends = graph.select(F.explode("adjacencies").alias("key")).distinct()
    if ends.join(graph, "key", "left_anti").limit(1).count():
        raise ValueError("edges lead to vertices without a row")


def naive_messages(graph: DataFrame, context: StepContext | None = None) -> DataFrame:
    """Every vertex itself, and distance + 1 to each neighbour of a reached one."""
    return graph.select("key", "distance", "adjacencies").unionByName(schimmy_messages(graph).withColumn("adjacencies", empty()))


def schimmy_messages(graph: DataFrame) -> DataFrame:
    """Distance + 1 to each neighbour of a reached vertex."""
    return graph.filter(F.col("distance").isNotNull()).select(F.explode("adjacencies").alias("key"), (F.col("distance") + 1).alias("distance"))


def seeds(graph: DataFrame) -> DataFrame:
    return graph.filter(F.col("distance") == 0)


def temporal_messages(delta: DataFrame, context: StepContext) -> DataFrame:
    """A bare key to each neighbour of what has changed; no vertex sends to itself."""
    senders = seeds(delta) if context.is_first_step else delta
    return senders.select(F.col("key").alias("src"), F.explode("adjacencies").alias("key")).filter("src != key").select("key")


def nearest(messages: DataFrame, context: StepContext | None = None) -> DataFrame:
    """Smallest distance and all neighbours of each key.

    Messages without neighbours, however many a key gets, add nothing to its list.
    """
    lists = F.collect_list(F.when(F.size("adjacencies") > 0, F.col("adjacencies")))
    return messages.groupBy("key").agg(F.min("distance").alias("distance"), F.sort_array(F.flatten(lists)).alias("adjacencies"))


def naive(graph: DataFrame, steps: int, checked: bool = True, **job) -> DataFrame:
    """Everything moves: each step sends vertices, neighbours and messages. ``checked`` graphs are well formed."""
    if not checked:
        return iterate(graph, naive_messages, nearest, steps, **job)
    spark = graph.sparkSession
    with temporaries(spark) as keep:
        graph = written(spark, graph, "graph")
        check(graph)
        found = iterate(graph, naive_messages, nearest, steps, **job)
        return found if steps and job.get("folder") else keep(found, "naive")


def schimmy(graph: DataFrame, steps: int, partitions: int | None = None, checked: bool = True) -> DataFrame:
    """The adjacencies and distances stay where they are; messages move."""

    def mapper(static: DataFrame, state: DataFrame, context: StepContext) -> DataFrame:
        return schimmy_messages(static.join(state, "key")).groupBy("key").agg(F.min("distance").alias("distance"))

    def reducer(state: DataFrame, messages: DataFrame, context: StepContext) -> DataFrame:
        return state.unionByName(messages).groupBy("key").agg(F.min("distance").alias("distance"))

    def validate(static: DataFrame) -> None:
        check(static.withColumnRenamed("start", "distance"))

    reached = graph.select("key", "distance").filter(F.col("distance").isNotNull())
    found = schimmy_iterate(graph.withColumnRenamed("distance", "start"), reached, mapper, reducer, steps, partitions, validate if checked else None)
    return found.select("key", "distance", "adjacencies")


def visits(step: int | None) -> list:
    """What the reducer needs of a key's versions: history up to ``step``, messages after it."""
    old = F.col("step") <= step if step is not None else F.lit(True)
    first = F.struct("step", F.col("distance").isNull(), "distance")
    return [
        F.count(F.when(old, 1)).alias("versions"),
        F.max(F.when(old, F.col("step"))).alias("last_step"),
        F.min_by(F.when(old, F.col("distance")), F.when(old, first)).alias("first_distance"),
        F.min_by(F.when(old, F.col("adjacencies")), F.when(old, first)).alias("first_adjacencies"),
        F.min(F.when(~old, F.col("step"))).alias("message_step"),
    ]


def distance_of():
    """The step of the last change if there was one, else the input's, else the message's."""
    return F.when(F.col("versions") >= 2, F.col("last_step").cast("long")).otherwise(F.coalesce("first_distance", F.col("message_step").cast("long")))


def temporal_reduce(intervals: DataFrame, context: StepContext) -> DataFrame:
    """Vertices reached for the first time; in the last step every vertex with its distance."""
    grouped = intervals.groupBy("key").agg(*visits(context.step))
    adjacencies = F.coalesce("first_adjacencies", empty()).alias("adjacencies")
    if context.is_last_step:
        return grouped.select("key", distance_of().alias("distance"), adjacencies)
    fresh = F.col("message_step").isNotNull() & (F.col("versions") == 1) & F.col("first_distance").isNull()
    return grouped.filter(fresh).select("key", F.lit(None).cast("long").alias("distance"), adjacencies)


def summarize(history: DataFrame) -> DataFrame:
    """One row a key: its distance so far and its neighbours."""
    return history.groupBy("key").agg(*visits(None)).select("key", distance_of().alias("distance"), F.coalesce("first_adjacencies", empty()).alias("adjacencies"))


def temporal(graph: DataFrame, steps: int, checkpoint=Never(), add_missing: bool = False, checked: bool = True, **job) -> DataFrame:
    """Only changes travel: a vertex's distance is the step in which it first changed.

    ``checked`` graphs are well formed; with ``add_missing`` targets of edges get rows.
    """
    if add_missing:
        graph = closed(graph)
    return temporal_iterate(graph, temporal_messages, temporal_reduce, steps, summarize, checkpoint, combine=DataFrame.distinct, validate=check if checked else None, **job)
