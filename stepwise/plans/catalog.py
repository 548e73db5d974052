"""Queries over the test tables, each with the same in SQL where it can be said."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import intervals, options
from ..functions.vertex import parse, render
from ..operators import reducers, streams
from ..operators.checkpoints import AtSteps
from ..operators.history import History
from ..operators.storage import fresh_path, written
from ..sources import adjacency, files
from . import bfs
from .iterate import StepContext, copartitioned, merge_join

STEPS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between orders and the parts in them, both ways; orders are even, parts odd."""
    sold = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2).alias("o"), (F.col("l_partkey") * 2 + 1).alias("p")).distinct()
    return sold.select(F.explode(F.array(F.struct(F.col("o").alias("src"), F.col("p").alias("dst")), F.struct(F.col("p").alias("src"), F.col("o").alias("dst")))).alias("e")).select("e.src", "e.dst")


def sources(spark: SparkSession, *keys: int) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(k).cast("long") for k in keys])).alias("key"))


def graph(spark: SparkSession, sf_dir: str, *keys: int) -> DataFrame:
    return adjacency.from_edges(pairs(spark, sf_dir), sources(spark, *(keys or (0,))))


def steps_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of users: version n is the type of their event n, by time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.row_number().over(order) - 1).alias("step"), F.col("event_type").alias("value"))


def distances(frame: DataFrame) -> DataFrame:
    return frame.select("key", "distance")


EDGES = """e0 AS (SELECT DISTINCT l_orderkey * 2 AS o, l_partkey * 2 + 1 AS p FROM lineitem),
    edges AS (SELECT o AS src, p AS dst FROM e0 UNION ALL SELECT p, o FROM e0)"""


def search_sql(steps: int, *keys: int) -> str:
    start = " UNION ALL ".join(f"SELECT {k}::BIGINT" for k in (keys or (0,)))
    return f"""WITH RECURSIVE {EDGES}, seeds(key) AS ({start}),
    verts AS (SELECT src AS key FROM edges UNION SELECT key FROM seeds),
    reach AS (SELECT key, 0::BIGINT AS d FROM seeds UNION SELECT e.dst, r.d + 1 FROM reach r JOIN edges e ON e.src = r.key WHERE r.d < {steps}),
    dist AS (SELECT key, min(d) AS distance FROM reach GROUP BY key),
    state AS (SELECT v.key, dist.distance FROM verts v LEFT JOIN dist ON v.key = dist.key)"""


USERS = "h AS (SELECT user_id AS key, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS step, event_type AS value FROM events)"
SPANS = f"WITH {USERS}, i AS (SELECT *, step AS valid_from, lead(step) OVER (PARTITION BY key ORDER BY step) AS valid_to FROM h)"
LINES = f"""{EDGES}, a AS (SELECT src AS key, '[' || string_agg(dst::VARCHAR, ',' ORDER BY dst) || ']' AS list FROM edges GROUP BY src),
    lines AS (SELECT key, CASE WHEN key = 0 THEN '(0, ' || list || ')' ELSE list END AS text FROM a)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


@query(f"{search_sql(STEPS)} SELECT key, distance FROM state")
def bfs_temporal(spark, sf_dir):
    return distances(bfs.temporal(graph(spark, sf_dir), STEPS))


@query(f"{search_sql(STEPS)} SELECT key, distance FROM state")
def bfs_temporal_checkpointed(spark, sf_dir):
    return distances(bfs.temporal(graph(spark, sf_dir), STEPS, AtSteps((1, 3))))


@query(f"{search_sql(4, 0, 1, 2)} SELECT key, distance FROM state")
def bfs_temporal_multisource(spark, sf_dir):
    return distances(bfs.temporal(graph(spark, sf_dir, 0, 1, 2), 4))


@query(f"{search_sql(3)} SELECT key, distance FROM state UNION ALL SELECT -1, 1")
def bfs_temporal_dangling(spark, sf_dir):
    own = graph(spark, sf_dir)
    led = own.withColumn("adjacencies", F.when(F.col("key") == 0, F.concat("adjacencies", F.array(F.lit(-1).cast("long")))).otherwise(F.col("adjacencies")))
    return distances(bfs.temporal(led, 3, add_missing=True))


@query(f"{search_sql(STEPS)} SELECT key, distance FROM state")
def bfs_naive(spark, sf_dir):
    return distances(bfs.naive(graph(spark, sf_dir), STEPS))


@query(f"{search_sql(STEPS)} SELECT key, distance FROM state")
def bfs_schimmy(spark, sf_dir):
    return distances(bfs.schimmy(graph(spark, sf_dir), STEPS))


@query(f"{search_sql(2)} SELECT key, distance FROM dist WHERE distance = 2")
def bfs_frontier_k(spark, sf_dir):
    return distances(bfs.temporal(graph(spark, sf_dir), 2).filter("distance = 2"))


@query("SELECT 0::BIGINT AS key, 0::BIGINT AS distance")
def bfs_seeds(spark, sf_dir):
    return distances(bfs.seeds(graph(spark, sf_dir)))


@query(f"{search_sql(1)}, m AS (SELECT key, distance FROM state UNION ALL SELECT e.dst, s.distance + 1 FROM state s JOIN edges e ON e.src = s.key WHERE s.distance IS NOT NULL) SELECT key, min(distance) AS distance FROM m GROUP BY key")
def bfs_min_distance(spark, sf_dir):
    return distances(bfs.nearest(bfs.naive_messages(bfs.naive(graph(spark, sf_dir), 1))))


@query(f"{search_sql(1)} SELECT key, distance FROM state UNION ALL SELECT e.dst, s.distance + 1 FROM state s JOIN edges e ON e.src = s.key WHERE s.distance IS NOT NULL")
def bfs_messages_naive(spark, sf_dir):
    return distances(bfs.naive_messages(bfs.naive(graph(spark, sf_dir), 1)))


@query(f"{search_sql(1)} SELECT e.dst AS key, s.distance + 1 AS distance FROM state s JOIN edges e ON e.src = s.key WHERE s.distance IS NOT NULL")
def bfs_messages_schimmy(spark, sf_dir):
    return bfs.schimmy_messages(bfs.naive(graph(spark, sf_dir), 1))


@query(f"WITH {EDGES} SELECT dst AS key FROM edges WHERE src = 0")
def bfs_messages_temporal(spark, sf_dir):
    return bfs.temporal_messages(graph(spark, sf_dir), StepContext(0, 1))


@query(f"WITH {EDGES} SELECT src, dst FROM edges")
def edge_expand(spark, sf_dir):
    return adjacency.edges(graph(spark, sf_dir))


@query(f"WITH {EDGES} SELECT src AS key, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS adjacencies FROM edges GROUP BY src")
def adjacency_concat(spark, sf_dir):
    single = pairs(spark, sf_dir).select(F.col("src").alias("key"), F.lit(None).cast("long").alias("distance"), F.array("dst").alias("adjacencies"))
    return bfs.nearest(single).select("key", F.array_join("adjacencies", ",").alias("adjacencies"))


@query(f"WITH {EDGES}, v AS (SELECT src AS key, count(*) AS degree FROM edges GROUP BY src), m AS (SELECT dst AS key, min(src) AS nearest FROM edges GROUP BY dst) SELECT v.key, degree, nearest FROM v LEFT JOIN m ON v.key = m.key")
def schimmy_merge_join(spark, sf_dir):
    edges = pairs(spark, sf_dir)
    static = copartitioned(edges.groupBy(F.col("src").alias("key")).agg(F.count("*").alias("degree")))
    messages = edges.groupBy(F.col("dst").alias("key")).agg(F.min("src").alias("nearest"))
    out = written(spark, merge_join(static, messages), "merge-join")
    static.unpersist()
    return out


@query(f"{SPANS} SELECT key, step, value, valid_from, valid_to, valid_to IS NULL AS is_current FROM i")
def validity_intervals(spark, sf_dir):
    return intervals.validity(steps_of_users(spark, sf_dir))


@query(f"WITH {USERS}, u AS (SELECT key, step, value FROM h WHERE step <= 2 UNION ALL SELECT key, 3, 'message' FROM h WHERE step = 0) SELECT key, step, value, step AS valid_from, lead(step) OVER (PARTITION BY key ORDER BY step) AS valid_to FROM u")
def temporal_merge(spark, sf_dir):
    history = steps_of_users(spark, sf_dir)
    messages = history.filter("step = 0").select("key", F.lit(3).alias("step"), F.lit("message").alias("value"))
    return intervals.validity(streams.merge(history.filter("step <= 2"), messages)).drop("is_current")


@query(f"WITH {USERS}, l AS (SELECT *, lag(value) OVER (PARTITION BY key ORDER BY step) AS before FROM h) SELECT key, step, value FROM l WHERE before IS NULL OR before <> value")
def tnf_normalize(spark, sf_dir):
    return intervals.normalized(steps_of_users(spark, sf_dir), ["value"])


@query(f"{SPANS} SELECT key, value, valid_from, valid_to FROM i WHERE valid_from <= 10 AND (valid_to IS NULL OR valid_to > 10)")
def as_of_step(spark, sf_dir):
    return intervals.as_of(intervals.validity(steps_of_users(spark, sf_dir)), 10).select("key", "value", "valid_from", "valid_to")


@query(f"{SPANS} SELECT key, valid_from AS start, valid_to AS stop, valid_to - valid_from AS size, '[' || valid_from || ', ' || coalesce(valid_to::VARCHAR, 'inf') || ')' AS text FROM i")
def interval_accessors(spark, sf_dir):
    return intervals.validity(steps_of_users(spark, sf_dir)).select("key", F.col("valid_from").alias("start"), F.col("valid_to").alias("stop"), intervals.size().alias("size"), intervals.text().alias("text"))


@query(f"WITH {USERS} SELECT key, arg_min(value, step) AS first_value, arg_max(value, step) AS last_value FROM h GROUP BY key")
def first_last_version(spark, sf_dir):
    return intervals.first_last(steps_of_users(spark, sf_dir), "value")


@query(f"WITH {USERS} SELECT key, count(*) FILTER (WHERE step < 5) AS previous, count(*) FILTER (WHERE step = 5) AS current FROM h WHERE step <= 5 GROUP BY key")
def previous_current_split(spark, sf_dir):
    previous, current = intervals.split(steps_of_users(spark, sf_dir), 5)
    count = lambda frame, name: frame.groupBy("key").agg(F.count("*").alias(name))
    return count(previous, "previous").join(count(current, "current"), "key", "full").fillna(0, ["previous", "current"])


@query(f"WITH {USERS} SELECT key, step, value FROM h WHERE step = 3")
def history_at_step(spark, sf_dir):
    return History(steps_of_users(spark, sf_dir)).at(3)


@query(f"WITH {USERS} SELECT key, step, value FROM h WHERE step BETWEEN 2 AND 5")
def history_range(spark, sf_dir):
    return History(steps_of_users(spark, sf_dir)).between(2, 5)


@query(f"WITH {USERS} SELECT key, step, value FROM h WHERE step > 40")
def history_since_checkpoint(spark, sf_dir):
    return History(steps_of_users(spark, sf_dir)).since(40)


@query(f"WITH {USERS} SELECT key, step, value FROM h WHERE step % 2 = 0")
def aggregation_steps(spark, sf_dir):
    return History(steps_of_users(spark, sf_dir)).where(lambda step: step % 2 == 0)


def latest(history: DataFrame) -> DataFrame:
    return history.groupBy("key").agg(F.max_by("value", "step").alias("value"))


@query(f"WITH {USERS}, c AS (SELECT key, arg_max(value, step) AS value, 0 AS step FROM h WHERE step <= 20 GROUP BY key) SELECT key, value, step FROM c UNION ALL SELECT key, value, step FROM h WHERE step > 20")
def checkpoint_state(spark, sf_dir):
    return History(steps_of_users(spark, sf_dir)).compacted(latest, 20).rows.select("key", "value", "step")


@query("SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def merge_two(spark, sf_dir):
    return streams.merge(*named(spark, sf_dir)[:2], order=["key"])


def named(spark, sf_dir):
    pick = lambda t, k, n: table(spark, sf_dir, t).select(F.col(k).cast("long").alias("key"), F.col(n).alias("name"))
    return pick("nation", "n_nationkey", "n_name"), pick("region", "r_regionkey", "r_name"), pick("supplier", "s_suppkey", "s_name")


THREE = "SELECT n_nationkey::BIGINT AS key, n_name AS name, 0 AS step FROM nation UNION ALL SELECT r_regionkey, r_name, 1 FROM region UNION ALL SELECT s_suppkey, s_name, 2 FROM supplier"


@query(f"SELECT key, name FROM ({THREE})")
def merge_many(spark, sf_dir):
    return streams.merge(*named(spark, sf_dir), order=["key", "name"])


@query(THREE)
def merge_with_index(spark, sf_dir):
    return streams.merge_with_index(*named(spark, sf_dir))


@query(f"SELECT key + 1 AS key, upper(name) AS name FROM ({THREE})")
def merge_mapped(spark, sf_dir):
    return streams.merge_mapped(lambda s: s.select((F.col("key") + 1).alias("key"), F.upper("name").alias("name")), *named(spark, sf_dir))


@query("SELECT o_custkey AS key, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY o_custkey")
def group_by_key(spark, sf_dir):
    return streams.group_by_key(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "key"), "key", F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY o_orderpriority")
def group_identity(spark, sf_dir):
    return streams.group_identity(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("value")), "value")


OPTIONAL = "(SELECT l_suppkey AS key, CASE WHEN l_linenumber > 1 THEN l_partkey END AS a, CASE WHEN l_linenumber < 3 THEN l_orderkey END AS b FROM lineitem)"


def optional(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.when(F.col("l_linenumber") > 1, F.col("l_partkey")).alias("a"), F.when(F.col("l_linenumber") < 3, F.col("l_orderkey")).alias("b"))


@query(f"SELECT key, min(a) AS least, max(b) AS most FROM {OPTIONAL} GROUP BY key")
def min_max_option(spark, sf_dir):
    return optional(spark, sf_dir).groupBy("key").agg(options.min_option("a").alias("least"), options.max_option("b").alias("most"))


@query(f"SELECT key, least(a, b) AS low, greatest(a, b) AS high FROM {OPTIONAL}")
def pair_min_max(spark, sf_dir):
    return optional(spark, sf_dir).select("key", options.pair_min(F.col("a"), F.col("b")).alias("low"), options.pair_max(F.col("a"), F.col("b")).alias("high"))


@query("SELECT o_custkey AS key, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY o_custkey")
def arg_min_max(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(options.min_by("o_orderkey", ["o_orderdate", "o_orderkey"]).alias("first"), options.max_by("o_orderkey", ["o_orderdate", "o_orderkey"]).alias("last"))


@query("SELECT o_custkey AS key, count(*) > 1 AS multiple, count(*) = 1 AS single FROM orders GROUP BY o_custkey")
def cardinality_tests(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(options.has_multiple().alias("multiple"), options.has_single().alias("single"))


@query(f"SELECT key, concat_ws(',', a::VARCHAR, b::VARCHAR) AS pair, (a IS NOT NULL)::INTEGER + (b IS NOT NULL)::INTEGER AS size FROM {OPTIONAL}")
def pair_ops(spark, sf_dir):
    pair = options.pair_flatten(F.col("a"), F.col("b"))
    return optional(spark, sf_dir).select("key", F.array_join(F.transform(pair, lambda x: x.cast("string")), ",").alias("pair"), F.size(pair).alias("size"))


@query("SELECT o_orderkey AS key, (o_orderkey % 7)::INTEGER AS part FROM orders")
def partition_assignment(spark, sf_dir):
    keyed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return streams.partitioned(keyed, "key", 7).select("key", F.spark_partition_id().alias("part"))


def adjacency_file(spark, sf_dir) -> str:
    path = fresh_path(spark, "adjacency")
    adjacency.write(graph(spark, sf_dir), path)
    return path


@query(f"WITH {EDGES} SELECT src AS key, CASE WHEN src = 0 THEN 0::BIGINT END AS distance, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS adjacencies FROM edges GROUP BY src")
def adjacency_scan(spark, sf_dir):
    return adjacency.read(spark, adjacency_file(spark, sf_dir)).withColumn("adjacencies", F.array_join("adjacencies", ","))


@query(f"WITH {LINES} SELECT key, text FROM lines")
def adjacency_scan_raw(spark, sf_dir):
    return adjacency.read_raw(spark, adjacency_file(spark, sf_dir))


@query(f"WITH {LINES} SELECT key || chr(9) || text AS value FROM lines")
def output_lines(spark, sf_dir):
    return files.lines(spark, adjacency_file(spark, sf_dir))


@query(f"WITH {EDGES} SELECT src AS key, CASE WHEN src = 0 THEN 0::BIGINT END AS distance, count(*)::INTEGER AS degree, sum(dst)::BIGINT AS total FROM edges GROUP BY src")
def adjacency_parse(spark, sf_dir):
    text = graph(spark, sf_dir).select("key", render(F.col("distance"), F.col("adjacencies")).alias("text"))
    parsed = text.select("key", parse(F.col("text")).alias("v"))
    return parsed.select("key", "v.distance", F.size("v.adjacencies").alias("degree"), F.aggregate("v.adjacencies", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"WITH {LINES} SELECT key, text FROM lines")
def adjacency_render(spark, sf_dir):
    return graph(spark, sf_dir).select("key", render(F.col("distance"), F.col("adjacencies")).alias("text"))


@query("SELECT range AS key, range AS value FROM range(100)")
def mock_source(spark, sf_dir):
    return adjacency.mock(spark)


@query(f"{SPANS} SELECT key, count(*) AS versions, max(valid_to - valid_from)::BIGINT AS longest FROM i GROUP BY key")
def udf_temporal_reduce(spark, sf_dir):
    def reducer(key, versions: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [key], "versions": [len(versions)], "longest": (versions["valid_to"] - versions["valid_from"]).max()})

    return reducers.temporal_reduce(steps_of_users(spark, sf_dir), reducer, "key long, versions long, longest long")


@query(f"WITH {USERS} SELECT key, count(*) FILTER (WHERE step < 60) AS previous, count(*) FILTER (WHERE step >= 60) AS current FROM h GROUP BY key")
def udf_split_reduce(spark, sf_dir):
    def reducer(key, before: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [key], "previous": [len(before)], "current": [len(now)]})

    history = steps_of_users(spark, sf_dir)
    return reducers.split_reduce(history.filter("step < 60"), history.filter("step >= 60"), reducer, "key long, previous long, current long")
