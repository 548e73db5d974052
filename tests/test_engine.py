import random

import pytest
from pyspark.sql import functions as F

from stepwise.functions import intervals
from stepwise.functions.vertex import parse, render
from stepwise.operators import checkpoints
from stepwise.operators.history import History
from stepwise.plans import bfs
from stepwise.plans.iterate import copartitioned, merge_join, temporal_iterate
from stepwise.sources import adjacency, files

SCHEMA = "key long, distance long, adjacencies array<long>"
GRAPHS = {
    "example": [(1000, 0, [1001, 1002]), (1001, None, []), (1002, None, [1003]), (1003, None, [1001])],
    "loops": [(0, 0, [0, 1]), (1, None, [2]), (2, None, [0, 1]), (3, None, [0])],
    "sources": [(0, 0, [2]), (1, 0, [3]), (2, None, [4]), (3, None, [4]), (4, None, [5]), (5, None, [])],
    "fan_in": [(0, 0, [1, 2, 3, 4, 5]), *[(i, None, [6]) for i in range(1, 6)], (6, None, [])],
    "parallel": [(0, 0, [1, 1, 1]), (1, None, [])],
}


def walked(rows, steps):
    near, out = {k: a for k, _, a in rows}, {k: d for k, d, _ in rows}
    front = [k for k, d in out.items() if d == 0]
    for step in range(1, steps + 1):
        front = [b for b in {b for a in front for b in near[a]} if out[b] is None]
        out |= dict.fromkeys(front, step)
    return out


def asked(frame):
    rows = frame.select("key", "distance").collect()
    out = {r.key: r.distance for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("name", GRAPHS)
def test_searches_agree(spark, name):
    rows = GRAPHS[name]
    graph = spark.createDataFrame(rows, SCHEMA)
    want = walked(rows, 2)
    assert asked(bfs.temporal(graph, 2)) == want
    assert asked(bfs.naive(graph, 2)) == want
    assert asked(bfs.schimmy(graph, 2)) == want
    assert asked(bfs.temporal(graph, 2, checkpoints.AtSteps((1,)))) == want


def test_random_graph_with_checkpoints(spark):
    rng = random.Random(3)
    rows = [(i, 0 if i == 0 else None, [rng.randrange(40) for _ in range(rng.randrange(3))]) for i in range(40)]
    graph = spark.createDataFrame(rows, SCHEMA)
    assert asked(bfs.temporal(graph, 4, checkpoints.AtSteps((0, 2)))) == walked(rows, 4)


def test_ill_formed_graphs(spark):
    with pytest.raises(ValueError, match="without a row"):
        bfs.check(spark.createDataFrame([(0, 0, [9])], SCHEMA))
    with pytest.raises(ValueError, match="repeat"):
        bfs.check(spark.createDataFrame([(0, 0, []), (0, None, [])], SCHEMA))
    with pytest.raises(ValueError, match="distance 0"):
        bfs.check(spark.createDataFrame([(0, 5, [])], SCHEMA))
    assert asked(bfs.temporal(spark.createDataFrame([(0, 0, [9])], SCHEMA), 2, add_missing=True)) == {0: 0, 9: 1}


def test_no_steps_return_the_input(spark):
    graph = spark.createDataFrame(GRAPHS["example"], SCHEMA)
    assert asked(bfs.temporal(graph, 0)) == walked(GRAPHS["example"], 0)


@pytest.mark.parametrize(("text", "want"), [("", (None, [])), ("[]", (None, [])), ("[1,2,3]", (None, [1, 2, 3])), ("(0, [1001, 1002])", (0, [1001, 1002])), ("(3,[])", (3, [])), ("[01,2]", (None, [1, 2])), ("[1,-2]", (None, [1, -2])), ("(3,--[1])", (3, [1]))])
def test_vertex_text(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(parse(F.col("t")).alias("v")).first().v
    assert (row.distance, row.adjacencies) == want


@pytest.mark.parametrize("text", ["(None, [1])", "[1,2,]", "[1 2]", "[-2]", "(-1, [2])", "(3)", " []", "[1,;;2]"])
def test_other_text_is_an_error(spark, text):
    with pytest.raises(Exception, match=r"not a vertex|CAST_INVALID"):
        spark.createDataFrame([(text,)], "t string").select(parse(F.col("t"))).collect()


def test_render_and_files(spark, tmp_path):
    graph = spark.createDataFrame(GRAPHS["example"], SCHEMA)
    lines = [r[0] for r in graph.select(render(F.col("distance"), F.col("adjacencies"))).collect()]
    assert lines == ["(0, [1001,1002])", "", "[1003]", "[1001]"]
    adjacency.write(graph, str(tmp_path / "g"))
    assert sorted(adjacency.read(spark, str(tmp_path / "g")).collect()) == sorted(graph.collect())
    assert len(list(files.fetch(spark, str(tmp_path / "g")))) == 4
    assert files.listed(spark, str(tmp_path / "g")).count() >= 1


def test_intervals_and_history(spark, tmp_path):
    rows = [(1, 0, "a"), (1, 3, "b"), (2, 0, "c"), (2, 2, "x"), (2, 2, "y")]
    history = History(spark.createDataFrame(rows, "key long, step int, value string"))
    got = {(r.key, r.value): (r.valid_from, r.valid_to) for r in history.intervals(tie=["value"]).collect()}
    assert got == {(1, "a"): (0, 3), (1, "b"): (3, None), (2, "c"): (0, 2), (2, "x"): (2, 2), (2, "y"): (2, None)}
    assert intervals.as_of(history.intervals(["value"]), 2).count() == 2
    history.save(str(tmp_path / "h"))
    assert History.load(spark, str(tmp_path / "h")).at(2).count() == 2


def test_static_side_does_not_move(spark):
    static = copartitioned(spark.range(1000).select(F.col("id").alias("key"), F.lit(1).alias("v")), partitions=4)
    static.count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    plan = merge_join(static, spark.range(10).select(F.col("id").alias("key"), F.lit(2).alias("m")))._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # One exchange for the messages; the other is inside the cached static side.
    assert plan.split("InMemoryTableScan")[0].count("Exchange") + plan.split("SortMergeJoin")[-1].count("ENSURE_REQUIREMENTS") == 1


def test_checkpoint_policies():
    with pytest.warns(UserWarning, match="never active"):
        policy = checkpoints.from_conf("10, 15", 3)
    assert policy.last(12) == 10
    assert policy.last(10, inclusive=False) is None
    assert checkpoints.from_conf("") == checkpoints.Never()


def test_checkpoints_need_a_summary(spark):
    with pytest.raises(ValueError, match="summarize"):
        temporal_iterate(spark.range(1), None, None, 1, checkpoint=checkpoints.AtSteps((0,)))
