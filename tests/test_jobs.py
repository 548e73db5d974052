import os

import pytest
from pyspark.sql import functions as F

from stepwise.__main__ import main
from stepwise.operators import checkpoints, storage, streams
from stepwise.operators.steps import Steps, dealt_plans, step_files, step_path
from stepwise.plans import bfs, catalog
from stepwise.plans.iterate import Step, iterate, run_steps, temporal_iterate
from stepwise.sources import adjacency, files
from stepwise.streaming.deltas import append_steps

SCHEMA = "key long, distance long, adjacencies array<long>"
CHAIN = [(i, 0 if i == 0 else None, [i + 1] if i < 7 else []) for i in range(8)]
CHECKPOINTS = (checkpoints.Never(), checkpoints.AtSteps((1,)), checkpoints.AtSteps((0, 2, 3)))


def asked(frame):
    rows = frame.collect()
    out = {r.key: r.distance for r in rows}
    assert len(out) == len(rows)
    return out


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def chain(spark):
    return spark.createDataFrame(CHAIN, SCHEMA)


def test_history_is_not_shuffled(spark, chain):
    """Of all that a step merges, the messages alone pass an exchange."""
    seen = []

    def reducer(merged, context):
        out = bfs.temporal_reduce(merged, context)
        seen.append((plan(out), plan(merged)))
        return out

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    mapper = lambda delta, context: bfs.temporal_messages(delta, context)
    out = temporal_iterate(chain, mapper, reducer, 4, bfs.summarize, checkpoints.AtSteps((2,)), combine=lambda m: m.distinct(), partitions=3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert asked(out) == {k: k if k <= 4 else None for k in range(8)}
    for step, plans in enumerate(seen):
        for text in plans:
            # The union's last input are the messages, and below them is one scan, that of the
            # last changes. Nothing above or beside them is an exchange.
            moved = text[text.index("Exchange") :]
            assert moved.count("FileScan") == 1
            assert text.count("FileScan") == (2, 3, 2, 3)[step]


def test_history_alone_keeps_a_key_together(spark):
    """Tables in buckets are merged bucket by bucket, without messages too."""
    first = spark.range(100).select(F.col("id").alias("key"), F.lit("a").alias("value"))
    store = Steps(spark, first.schema, 3)
    with dealt_plans(spark, 3):
        for step in range(3):
            store.write(first, step)
        merged = store.history(2).groupBy("key").agg(F.count("*").alias("n"))
        assert "Exchange" not in plan(merged)
        assert [r.n for r in merged.collect()] == [3] * 100
        store.forget()
    assert store.between(0, 2).groupBy("key").count().filter("count = 3").count() == 100


def test_input_is_read_once(spark):
    """The graph is made once, however many steps and versions read it."""
    folder = "/root/testdata/sf0.001"
    spark.sparkContext.setJobGroup("search", "search")
    graph = catalog.graph(spark, folder)
    calls = []
    made = graph.withColumn("distance", F.udf(lambda d: d, "long")("distance"))
    out = bfs.temporal(made, 3, checked=False, on_step_end=lambda context, delta: calls.append(plan(delta)))
    assert out.count() == graph.count()
    assert not any("lineitem" in x or "BatchEvalPython" in x for x in calls)


@pytest.mark.parametrize("checkpoint", CHECKPOINTS)
@pytest.mark.parametrize("stopped", [0, 1, 2, 3])
def test_stopped_jobs_go_on(spark, chain, tmp_path, checkpoint, stopped):
    class Stop(Exception):
        pass

    begun = []

    def setup(context):
        begun.append(context.step)
        if len(begun) == stopped + 1:
            raise Stop

    folder = str(tmp_path / "job")
    with pytest.raises(Stop):
        bfs.temporal(chain, 4, checkpoint, folder=folder, setup=setup)
    assert asked(bfs.temporal(chain, 4, checkpoint, folder=folder, setup=setup)) == {k: k if k <= 4 else None for k in range(8)}
    assert begun == [*range(stopped + 1), *range(stopped, 4)]


def test_a_checkpoint_written_before_the_stop_is_used(spark, chain, tmp_path):
    summaries = []

    def summarize(history):
        summaries.append(1)
        return bfs.summarize(history)

    def reducer(merged, context):
        if context.step == 2 and len(summaries) == 1 and not stopped:
            stopped.append(1)
            raise InterruptedError
        return bfs.temporal_reduce(merged, context)

    stopped = []
    job = lambda: temporal_iterate(chain, bfs.temporal_messages, reducer, 4, summarize, checkpoints.AtSteps((2,)), folder=str(tmp_path))
    with pytest.raises(InterruptedError):
        job()
    assert asked(job()) == {k: k if k <= 4 else None for k in range(8)}
    assert len(summaries) == 1


def test_half_written_tables_do_not_count(spark, tmp_path):
    frame = spark.range(5).select(F.col("id").alias("key"))
    store = Steps(spark, frame.schema, 2, folder=str(tmp_path))
    assert store.last() is None
    with dealt_plans(spark, 2):
        store.write(frame, 0)
        store.write(frame, 1)
        store.write(frame, 1, checkpoint=True)
    os.remove(f"{store.path(1)}/_SUCCESS")
    assert (store.last(), store.listed(), store.listed(checkpoints=True)) == (0, [0], [1])
    with dealt_plans(spark, 2):
        store.write(frame.limit(3), 1)
    assert (store.last(), store.read(1).count()) == (1, 3)
    os.remove(f"{store.path(1)}/_SUCCESS")
    assert {r.step for r in step_files(spark, store.folder).collect()} == {0, 1}
    store.forget()
    assert spark.catalog.listTables() == [] or not any(t.name.startswith("stepwise_") for t in spark.catalog.listTables())
    with pytest.raises(ValueError, match="step"):
        Steps(spark, frame.withColumn("step", F.lit(1)).schema, 2)


def test_without_reading_its_own_checkpoint(spark, chain, monkeypatch):
    monkeypatch.setattr(Steps, "reads_own_checkpoint", False)
    assert asked(bfs.temporal(chain, 4, checkpoints.AtSteps((1, 3)))) == {k: k if k <= 4 else None for k in range(8)}


def test_normal_form_hooks_and_filters(spark):
    first = spark.createDataFrame([(1, "a"), (2, "b")], "key long, value string")
    newest = lambda merged, context: merged.groupBy("key").agg(F.max_by("value", "step").alias("value"))
    said, sizes = [], []
    temporal_iterate(first, lambda d, c: d, newest, 3, enforce_tnf=True, setup=lambda c: said.append(("setup", c.step)), cleanup=lambda c: said.append(("cleanup", c.step)), on_step_end=lambda c, d: sizes.append(d.count()))
    assert sizes == [0, 0, 2]
    assert said == [(x, s) for s in range(3) for x in ("setup", "cleanup")]
    shout = lambda merged, context: merged.groupBy("key").agg(F.upper(F.max_by("value", "step")).alias("value"))
    out = temporal_iterate(first, lambda d, c: d.limit(0), shout, 2, steps_filter=lambda step: step == 0)
    assert {r.value for r in out.collect()} == {"A", "B"}


def test_composed_steps(spark, tmp_path):
    state = spark.createDataFrame([(k, 1) for k in (1, 1, 1, 2, 2, 3)], "key long, value long")
    total = lambda s, c: s.groupBy("key").agg(F.sum("value").alias("value"))
    swap = lambda s, c: s.select(F.col("value").alias("key"), F.col("key").alias("value"))
    job = [Step(lambda s, c: s, total), Step(swap, total)]
    assert {(r.key, r.value) for r in run_steps(state, job).collect()} == {(3, 1), (2, 2), (1, 3)}
    out = run_steps(state, job, partitions=2, partitioner=streams.partition_of, folder=str(tmp_path), name="j")
    placed = out.select("key", F.regexp_extract(F.input_file_name(), "part-([0-9]+)-", 1).cast("int").alias("part")).collect()
    assert all(r.part == r.key % 2 for r in placed)
    assert {(r.key, r.value) for r in spark.read.parquet(str(tmp_path / "j/step-1")).collect()} == {(1, 3), (2, 2), (3, 1)}
    again = run_steps(state, [Step(None, None), *job[1:]], folder=str(tmp_path), name="j")
    assert again.count() == 3
    with pytest.raises(TypeError, match="keep the schema"):
        iterate(state, lambda s, c: s, lambda s, c: s.withColumn("more", F.lit(1)), 1)
    assert iterate(state, lambda s, c: s, lambda s, c: s.withColumn("more", F.lit(1)), 1, composable=False).columns == ["key", "value", "more"]
    with pytest.raises(ValueError, match="number of partitions"):
        run_steps(state, job, partitioner=streams.partition_of)


def test_paths_of_steps():
    assert [step_path(s, 2, "in", "out", "tmp/", "j") for s in range(3)] == ["in", "tmp/j/step-1", "out"]


@pytest.mark.parametrize("search", [bfs.temporal, bfs.naive, bfs.schimmy])
def test_searches_refuse_ill_formed_graphs(spark, search):
    for rows, what in (([(0, 0, [9])], "without a row"), ([(0, 0, []), (0, None, [])], "repeat"), ([(0, 5, [])], "distance 0")):
        with pytest.raises(ValueError, match=what):
            search(spark.createDataFrame(rows, SCHEMA), 1)


def test_a_hub_gathers_no_empty_lists(spark):
    rows = [(1, None, [2])] + [(1, i, []) for i in range(50)]
    out = bfs.nearest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in out] == [(1, 0, [2])]
    assert [tuple(r) for r in bfs.nearest(spark.createDataFrame(rows[1:], SCHEMA)).collect()] == [(1, 0, [])]


@pytest.mark.parametrize("algorithm", ["temporal", "schimmy", "naive"])
def test_command_line(spark, chain, tmp_path, capsys, algorithm):
    adjacency.write(chain, str(tmp_path / "in"))
    given = ["--algorithm", algorithm, "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--steps", "3", "--partitions", "2", "--checkpoints", "1"]
    assert main([*given, "--verbose", "--local-output", str(tmp_path)]) == 0
    said = capsys.readouterr().out.splitlines()
    assert said[-1] == str(tmp_path / "out")
    assert "3\t(3, [4])" in said
    assert "3\t(3, [4])" in (tmp_path / "result.txt").read_text().splitlines()
    assert asked(adjacency.read(spark, str(tmp_path / "out"))) == {k: k if k <= 3 else None for k in range(8)}
    assert main([*given, "--keep-output"]) == 1
    assert "is there already" in capsys.readouterr().err
    adjacency.write(chain.filter("key < 7"), str(tmp_path / "open"))
    open_graph = ["--algorithm", algorithm, "--input", str(tmp_path / "open"), "--steps", "1"]
    assert main(open_graph) == 1
    assert "without a row" in capsys.readouterr().err
    assert main([*open_graph, "--add-missing"]) == 0
    assert adjacency.read(spark, str(tmp_path / "open/output")).count() == 8


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    files.upload(spark, str(tmp_path / "a.txt"), str(tmp_path / "there/b.txt"))
    assert list(files.fetch(spark, str(tmp_path / "there/b.txt"))) == ["one", "two"]
    (tmp_path / "local").mkdir()
    assert list(files.fetch(spark, str(tmp_path / "there/b.txt"), str(tmp_path / "local"))) == ["one", "two"]
    assert list(files.fetch(spark, str(tmp_path / "there/b.txt"), str(tmp_path / "local"), "c.txt")) == ["one", "two"]
    assert sorted(os.listdir(tmp_path / "local")) == ["b.txt", "c.txt"]
    assert files.listed(spark, str(tmp_path / "there")).count() == 1
    assert files.scheme(spark, str(tmp_path)) == "file"


def test_order_of_merges(spark):
    a = spark.createDataFrame([(5, "a"), (1, "b")], "key long, name string")
    b = spark.createDataFrame([(3, "c"), (1, "a"), (9, "z")], "key long, name string")
    want = [(1, "a"), (1, "b"), (3, "c"), (5, "a"), (9, "z")]
    merged = streams.merge_sorted(a, b, order=["key", "name"])
    assert [tuple(r) for r in merged.collect()] == want
    placed = streams.placed(merged, ["key", "name"]).collect()
    assert [(r.key, r.name) for r in sorted(placed, key=lambda r: r.place)] == want
    assert sorted(r.place for r in placed) == list(range(5))
    parts = streams.merge(a, b, order=["key", "name"]).withColumn("p", F.spark_partition_id()).collect()
    for p in {r.p for r in parts}:
        own = [(r.key, r.name) for r in parts if r.p == p]
        assert own == sorted(own)


def test_stream_of_changes(spark, tmp_path):
    """Micro-batches become steps; a stream that goes on adds steps after those there."""
    (tmp_path / "in").mkdir()
    rows = lambda n, v: spark.createDataFrame([(k, v) for k in range(n)], "key long, value string").coalesce(1)
    for number, value in enumerate(["a", "b"]):
        rows(3 - number, value).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("key long, value string").parquet(str(tmp_path / "in"))
        append_steps(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.key, r.value, r.step) for r in out.collect()) == [(0, "a", 1), (0, "b", 2), (1, "a", 1), (1, "b", 2), (2, "a", 1)]


def test_tables_are_deleted_with_their_block(spark):
    frame = spark.range(3)
    with storage.temporaries(spark) as keep:
        inner = storage.written(spark, frame, "t")
        place = inner.inputFiles()[0]
        with storage.temporaries(spark) as keep_inner:
            kept = keep_inner(frame, "t")
        assert kept.count() == 3
        last = keep(kept, "t")
    assert not storage.exists(spark, place)
    assert last.count() == 3


def test_no_silent_local_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: None)

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_folder(Session())
