"""Queries on jobs, step tables, files and small operators, each with the same in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..__main__ import main
from ..functions import intervals, options
from ..functions.vertex import parse, render
from ..operators import streams
from ..operators.checkpoints import AtSteps, Never, from_conf
from ..operators.history import History
from ..operators.steps import Steps, dealt_plans, step_files, step_path
from ..operators.storage import fresh_path, written
from ..sources import adjacency, files
from . import bfs
from .catalog import EDGES, SPANS, USERS, adjacency_file, distances, graph, latest, named, pairs, query, search_sql, steps_of_users, table
from .iterate import Step, StepContext, default_name, default_output, iterate, run_steps, temporal_iterate


def step_store(spark: SparkSession, sf_dir: str, last: int = 4) -> Steps:
    """The users' first versions as the outputs of steps."""
    history = steps_of_users(spark, sf_dir)
    store = Steps(spark, history.drop("step").schema, 4)
    with dealt_plans(spark, 4):
        for step in range(last + 1):
            store.write(history.filter(F.col("step") == step).drop("step"), step)
    store.forget()
    return store


@query(f"WITH {USERS} SELECT key, value, step FROM h WHERE step = 2")
def step_current_input(spark, sf_dir):
    """What a step reads of the one before it."""
    return step_store(spark, sf_dir).read(2)


@query(f"WITH {USERS} SELECT key, value, step FROM h WHERE step BETWEEN 1 AND 3")
def step_range(spark, sf_dir):
    return step_store(spark, sf_dir).between(1, 3)


@query(f"WITH {USERS} SELECT key, count(*) AS versions, arg_max(value, step) AS value FROM h WHERE step <= 4 GROUP BY key")
def step_merge_in_place(spark, sf_dir):
    """All versions of a key from tables that stay in their buckets."""
    store = step_store(spark, sf_dir)
    with dealt_plans(spark, 4):
        merged = store.history(4).groupBy("key").agg(F.count("*").alias("versions"), F.max_by("value", "step").alias("value"))
        out = written(spark, merged, "merged")
        store.forget()
    return out


@query("SELECT range::INTEGER AS step FROM range(5)")
def step_addresses(spark, sf_dir):
    """The steps that have files; the checkpoint beside them is none."""
    store = checkpointed_store(spark, sf_dir)
    return step_files(spark, store.folder).select("step").distinct()


def checkpointed_store(spark: SparkSession, sf_dir: str) -> Steps:
    store = step_store(spark, sf_dir)
    with dealt_plans(spark, 4):
        store.write(latest(store.history(2)), 2, checkpoint=True)
        store.forget()
    return store


@query(f"WITH {USERS} SELECT key, arg_max(value, step) AS value, 0 AS step FROM h WHERE step <= 2 GROUP BY key")
def checkpoint_scan(spark, sf_dir):
    """A checkpoint that was written, read back."""
    return checkpointed_store(spark, sf_dir).read(2, checkpoint=True)


@query(f"WITH {USERS} SELECT key, arg_max(value, step) AS value, 0 AS step FROM h WHERE step <= 2 GROUP BY key UNION ALL SELECT key, value, step FROM h WHERE step BETWEEN 3 AND 4")
def checkpoint_history(spark, sf_dir):
    """What a restarted job reads: the checkpoint and the steps after it."""
    return checkpointed_store(spark, sf_dir).history(4, checkpoint=2)


@query("SELECT true AS own, 2 AS checkpoint, 4 AS last")
def checkpoint_probe(spark, sf_dir):
    """Can a step read the checkpoint it writes itself; which outputs are there."""
    store = checkpointed_store(spark, sf_dir)
    return spark.createDataFrame([(store.reads_own_checkpoint, store.listed(checkpoints=True)[-1], store.last())], "own boolean, checkpoint int, last int")


POLICY = "CASE WHEN range >= 5 THEN 5 WHEN range >= 2 THEN 2 END"


@query(f"SELECT range::INTEGER AS step, ({POLICY})::INTEGER AS last, (CASE WHEN range > 5 THEN 5 WHEN range > 2 THEN 2 END)::INTEGER AS before, range IN (2, 5) AS active FROM range(8)")
def checkpoint_policy(spark, sf_dir):
    policy = from_conf("2, 5")
    return spark.createDataFrame([(s, policy.last(s), policy.last(s, inclusive=False), policy.is_active(s)) for s in range(8)], "step int, last int, before int, active boolean")


@query("SELECT range::INTEGER AS step, NULL::INTEGER AS last, false AS active FROM range(3)")
def checkpoint_never(spark, sf_dir):
    return spark.createDataFrame([(s, Never().last(s), Never().is_active(s)) for s in range(3)], "step int, last int, active boolean")


COUNTS = "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)"


def counted(state: DataFrame, context: StepContext) -> DataFrame:
    return state.groupBy("key").agg(F.sum("value").alias("value"))


def composed(spark: SparkSession, sf_dir: str, **job) -> DataFrame:
    """Orders for each customer, then customers for each such number: steps with mappers of their own."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.lit(1).cast("long").alias("value"))
    by_number = lambda state, context: state.select(F.col("value").alias("key"), F.lit(1).cast("long").alias("value"))
    return run_steps(orders, [Step(lambda state, context: state, counted), Step(by_number, counted)], **job)


@query(f"{COUNTS} SELECT n AS key, count(*) AS value FROM c GROUP BY n")
def composed_job(spark, sf_dir):
    return composed(spark, sf_dir)


@query(f"{COUNTS} SELECT n AS key, count(*) AS value, (n % 3)::INTEGER AS part FROM c GROUP BY n")
def composed_partitioned_job(spark, sf_dir):
    """Each step with a fixed number of reducers, keys left where a partitioner says."""
    folder = fresh_path(spark, "composed")
    out = composed(spark, sf_dir, partitions=3, partitioner=streams.partition_of, folder=folder)
    return out.withColumn("part", F.regexp_extract(F.input_file_name(), r"part-([0-9]+)-", 1).cast("int"))


@query("SELECT o_custkey AS key, count(*) AS value FROM orders GROUP BY o_custkey")
def step_sink(spark, sf_dir):
    """The output of a step that is not the last, under its name."""
    folder = fresh_path(spark, "named")
    composed(spark, sf_dir, folder=folder, name="orders")
    return spark.read.parquet(f"{folder}/orders/step-1")


@query(f"{search_sql(4)} SELECT key, distance FROM state")
def resumed_job(spark, sf_dir):
    """A job stopped after two of four steps goes on from their outputs."""
    own, folder = written(spark, graph(spark, sf_dir), "graph"), fresh_path(spark, "resumed")

    def stop(context: StepContext) -> None:
        if context.step == 2:
            raise InterruptedError

    try:
        bfs.temporal(own, 4, AtSteps((1,)), folder=folder, setup=stop)
    except InterruptedError:
        pass
    return distances(bfs.temporal(own, 4, AtSteps((1,)), folder=folder))


@query("SELECT * FROM (VALUES (0, 'in'), (1, 'tmp/bfs/step-1'), (2, 'tmp/bfs/step-2'), (3, 'out')) AS t(step, path)")
def step_paths(spark, sf_dir):
    return spark.createDataFrame([(s, step_path(s, 3, "in", "out", "tmp", "bfs")) for s in range(4)], "step int, path string")


@query("SELECT 'job_20240102030405' AS name, '/data/graph/output' AS output")
def job_defaults(spark, sf_dir):
    return spark.createDataFrame([(default_name(pd.Timestamp("2024-01-02 03:04:05").to_pydatetime()), default_output("/data/graph/"))], "name string, output string")


@query("SELECT range::INTEGER AS step, 3 AS steps, range = 0 AS first, range = 2 AS last FROM range(3)")
def step_context(spark, sf_dir):
    return spark.createDataFrame([(c.step, c.steps, c.is_first_step, c.is_last_step) for c in (StepContext(s, 3) for s in range(3))], "step int, steps int, first boolean, last boolean")


@query("SELECT * FROM (VALUES (0, 'setup'), (1, 'cleanup'), (2, 'setup'), (3, 'cleanup')) AS t(place, hook)")
def step_hooks(spark, sf_dir):
    """What is called around the steps of a job, in order."""
    said: list[str] = []
    own = spark.range(3).select(F.col("id").alias("key"), F.lit(1).alias("value"))
    step = Step(lambda state, context: state, lambda state, context: state, lambda context: said.append("setup"), lambda context: said.append("cleanup"))
    run_steps(own, [step, step])
    return spark.createDataFrame(list(enumerate(said)), "place int, hook string")


@query("SELECT o_custkey AS key, sum(o_orderkey)::BIGINT AS value FROM orders GROUP BY o_custkey")
def iterated_job(spark, sf_dir):
    """A job whose later steps find nothing more to add up."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"))
    return iterate(orders, lambda state, context: state, counted, 3)


@query(f"WITH {USERS} SELECT key, value FROM h WHERE step = 0")
def temporal_steps_filter(spark, sf_dir):
    """A reducer that is shown the versions of chosen steps only."""
    first = steps_of_users(spark, sf_dir).filter("step = 0").drop("step")

    def reducer(merged: DataFrame, context: StepContext) -> DataFrame:
        newest = merged.groupBy("key").agg(F.max_by("value", "step").alias("value"))
        return newest if context.is_last_step else newest.withColumn("value", F.lit("hidden"))

    return temporal_iterate(first, lambda delta, context: delta.limit(0), reducer, 2, steps_filter=lambda step: step == 0)


@query(f"WITH {USERS} SELECT key, value FROM h WHERE step = 0")
def temporal_normal_form(spark, sf_dir):
    """A job that emits every version twice, and is kept in normal form."""
    first = steps_of_users(spark, sf_dir).filter("step = 0").drop("step")
    again = lambda merged, context: merged.groupBy("key").agg(F.max_by("value", "step").alias("value"))
    counted_rows: list[int] = []
    out = temporal_iterate(first, lambda delta, context: delta, again, 3, enforce_tnf=True, on_step_end=lambda context, delta: counted_rows.append(delta.count()))
    return out if counted_rows[:2] == [0, 0] else out.limit(0)


@query(f"{search_sql(3)} SELECT key, distance FROM state")
def cli_search(spark, sf_dir):
    """The command line: a graph file in, a result file out."""
    source, output = adjacency_file(spark, sf_dir), fresh_path(spark, "cli")
    if main(["--algorithm", "temporal", "--input", source, "--output", output, "--steps", "3", "--partitions", "4", "--checkpoints", "1"]):
        raise RuntimeError("the command failed")
    return distances(adjacency.read(spark, output))


LINES = "SELECT range % 2 AS n, 'line ' || range AS value FROM range(6)"


def two_files(spark: SparkSession) -> str:
    folder = fresh_path(spark, "files")
    for n in (0, 1):
        files.put(spark.range(6).filter(F.col("id") % 2 == n).select(F.concat(F.lit("line "), F.col("id").cast("string")).alias("value")).coalesce(1), f"{folder}/{n}")
    return folder


@query("SELECT 2::BIGINT AS files, 42::BIGINT AS length")
def file_list(spark, sf_dir):
    """The files below a folder, of any depth."""
    return files.listed(spark, two_files(spark)).filter("path LIKE '%.txt'").agg(F.count("*").alias("files"), F.sum("length").alias("length"))


@query(f"SELECT value FROM ({LINES}) WHERE n = 1")
def file_open(spark, sf_dir):
    return files.lines(spark, f"{two_files(spark)}/1")


@query(f"SELECT value FROM ({LINES}) WHERE n = 0")
def file_get(spark, sf_dir):
    """One file's lines, streamed through the driver."""
    return spark.createDataFrame([(x,) for x in files.fetch(spark, f"{two_files(spark)}/0")], "value string")


@query("SELECT 'named.txt' AS name, 'line 0' AS first")
def file_get_named(spark, sf_dir):
    """A file copied to a folder of the driver under a name."""
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as local:
        lines = list(files.fetch(spark, f"{two_files(spark)}/0", local, "named.txt"))
        return spark.createDataFrame([(os.listdir(local)[0], lines[0])], "name string, first string")


@query(f"SELECT value FROM ({LINES})")
def file_get_all(spark, sf_dir):
    return files.lines(spark, f"{two_files(spark)}/*")


@query(f"SELECT value FROM ({LINES}) WHERE n = 1")
def file_put(spark, sf_dir):
    """A file put over another."""
    folder = two_files(spark)
    files.put(files.lines(spark, f"{folder}/1"), f"{folder}/0")
    return files.lines(spark, f"{folder}/0")


@query("SELECT 'file' AS scheme")
def file_system_of(spark, sf_dir):
    """Which file system a path belongs to."""
    return spark.createDataFrame([(files.scheme(spark, "/tmp"),)], "scheme string")


THREE = "SELECT n_nationkey::BIGINT AS key, n_name AS name, 0 AS step FROM nation UNION ALL SELECT r_regionkey, r_name, 1 FROM region UNION ALL SELECT s_suppkey, s_name, 2 FROM supplier"


@query(f"SELECT key, name, row_number() OVER (ORDER BY key, name) - 1 AS place FROM ({THREE})")
def merge_order(spark, sf_dir):
    """A merge in the order of its keys, over all partitions: the place of every row."""
    merged = streams.merge_sorted(*named(spark, sf_dir), order=["key", "name"])
    return streams.placed(merged, ["key", "name"]).select("key", "name", "place")


@query(f"SELECT key, step FROM ({THREE})")
def key_selector(spark, sf_dir):
    return streams.merge_with_index(*named(spark, sf_dir)).select("key", "step")


@query(f"SELECT key, name, step AS origin FROM ({THREE})")
def flatten_provenance(spark, sf_dir):
    """Pairs with the number of their stream, made flat."""
    paired = streams.merge_with_index(*[s.select(F.struct("key", "name").alias("pair")) for s in named(spark, sf_dir)], name="origin")
    return paired.select("pair.key", "pair.name", "origin")


@query(f"SELECT key, name, step FROM ({THREE})")
def stream_added(spark, sf_dir):
    """Streams that join a history one after the other."""
    first, second, third = named(spark, sf_dir)
    return History.start(first).append(second, 1).append(third, 2).rows


@query("SELECT o_orderkey AS key, o_custkey AS value FROM orders ORDER BY 1 LIMIT 1")
def first_match(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value")).orderBy("key").limit(1)


@query("SELECT o_orderkey AS key, sign(o_orderkey - o_custkey)::INTEGER AS compared FROM orders")
def key_comparison(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), streams.compared(F.col("o_orderkey"), F.col("o_custkey")).alias("compared"))


@query("SELECT (o_orderkey % 5)::INTEGER AS part, count(*) AS n FROM orders GROUP BY 1")
def partition_id(spark, sf_dir):
    keyed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return streams.partitioned(keyed, "key", 5).groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))


@query(f"WITH {EDGES}, l AS (SELECT src, dst FROM edges UNION ALL SELECT src, src FROM edges) SELECT dst AS key FROM l WHERE src <> dst")
def self_loops_removed(spark, sf_dir):
    edges = pairs(spark, sf_dir)
    looped = edges.groupBy(F.col("src").alias("key")).agg(F.concat(F.collect_list("dst"), F.collect_list("src")).alias("adjacencies"))
    return bfs.temporal_messages(looped, StepContext(1, 2))


@query(f"{search_sql(1)} SELECT key, distance + 1 AS distance FROM state WHERE distance IS NOT NULL")
def known_distances(spark, sf_dir):
    """Vertices that have been reached send their distance and one; others nothing."""
    reached = bfs.naive(graph(spark, sf_dir), 1)
    return bfs.schimmy_messages(reached.withColumn("adjacencies", F.array("key")))


@query("SELECT l_linenumber AS value FROM lineitem WHERE l_linenumber > 2")
def none_dropped(spark, sf_dir):
    optional = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).alias("value"))
    return options.defined(optional, "value")


@query(f"WITH {USERS} SELECT key, value AS first FROM h WHERE step = 0")
def first_version(spark, sf_dir):
    return intervals.first_last(steps_of_users(spark, sf_dir), "value").select("key", F.col("first_value").alias("first"))


@query(f"{SPANS} SELECT key, step, value, lead(value) OVER (PARTITION BY key ORDER BY step) AS following FROM i")
def sliding_pairs(spark, sf_dir):
    return intervals.pairs(steps_of_users(spark, sf_dir), "value").select("key", "step", "value", "following")


@query(f"WITH {USERS} SELECT key, step, value, step < 7 AS previous FROM h WHERE step <= 7")
def previous_and_current(spark, sf_dir):
    """Versions from before a step, and those of the step itself, as two streams."""
    previous, current = intervals.split(steps_of_users(spark, sf_dir), 7)
    return previous.withColumn("previous", F.lit(True)).unionByName(current.withColumn("previous", F.lit(False)))


@query(f"{SPANS} SELECT key, value, valid_from AS first, valid_to AS end FROM i")
def interval_tuples(spark, sf_dir):
    """An interval and its value as one tuple, taken apart again."""
    tupled = intervals.validity(steps_of_users(spark, sf_dir)).select("key", intervals.tupled(F.col("value")).alias("t"))
    return tupled.select("key", "t.value", F.col("t.valid_from").alias("first"), F.col("t.valid_to").alias("end"))


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS value, o_orderkey % 3 = 0 AS ended FROM orders")
def next_option(spark, sf_dir):
    """The next value of a stream that may have ended."""
    value = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), value.alias("value"), value.isNull().alias("ended"))


@query(f"WITH {EDGES}, a AS (SELECT src AS key, list(dst ORDER BY dst) AS l FROM edges GROUP BY src) SELECT count(*) AS vertices, count(DISTINCT l) AS lists FROM a")
def vertex_equality(spark, sf_dir):
    """Vertices are equal when distance and neighbours are; parsing what was rendered gives an equal one."""
    own = graph(spark, sf_dir).select("key", F.struct(F.lit(None).cast("long").alias("distance"), "adjacencies").alias("v"))
    again = own.select("key", "v", parse(render(F.col("v.distance"), F.col("v.adjacencies"))).alias("w")).filter(F.col("v").eqNullSafe(F.col("w")))
    return again.agg(F.count("*").alias("vertices"), F.countDistinct("v").alias("lists"))


@query("SELECT o_custkey AS key, list(o_orderkey ORDER BY o_orderkey)[1] AS low, count(*) AS n FROM orders GROUP BY o_custkey")
def values_outlive_reads(spark, sf_dir):
    """Values gathered from a stream stay what they were when read."""

    def gathered(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        kept = list(frame["value"])
        return pd.DataFrame({"key": [key[0]], "low": [min(kept)], "n": [len(kept)]})

    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"))
    return orders.groupBy("key").applyInPandas(gathered, "key long, low long, n long")


@query("SELECT range AS key, CASE WHEN range % 2 = 0 THEN 'new' ELSE 'old' END AS value FROM range(4)")
def output_replaced(spark, sf_dir):
    """An output that was there is replaced; where it must not be, writing fails."""
    path = fresh_path(spark, "replaced")
    History.start(spark.range(9).select(F.col("id").alias("key"), F.lit("old").alias("value"))).save(path)
    new = spark.range(4).select(F.col("id").alias("key"), F.when(F.col("id") % 2 == 0, "new").otherwise("old").alias("value"))
    History.start(new).save(path)
    try:
        History.start(new.limit(0)).save(path, overwrite=False)
    except Exception:  # noqa: BLE001
        return History.load(spark, path).rows.drop("step")
    raise RuntimeError("an output was replaced")

