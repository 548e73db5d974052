"""Drivers of iterative jobs: a fixed number of steps, one plan for each."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import nullcontext
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import validity
from ..operators.checkpoints import Never
from ..operators.steps import Steps, dealt_plans
from ..operators.storage import exists, table, temporaries


@dataclass(frozen=True)
class StepContext:
    step: int
    steps: int
    name: str = ""

    @property
    def is_first_step(self) -> bool:
        return self.step == 0

    @property
    def is_last_step(self) -> bool:
        return self.step == self.steps - 1


def default_name(now: datetime | None = None) -> str:
    return f"job_{(now or datetime.now()):%Y%m%d%H%M%S}"


def default_output(path: str) -> str:
    return f"{path.rstrip('/')}/output"


Mapper = Callable[[DataFrame, StepContext], DataFrame]
Reducer = Callable[[DataFrame, StepContext], DataFrame]
Hook = Callable[[StepContext], None]
Partitioner = Callable[[Column, int], Column]


@dataclass(frozen=True)
class Step:
    """One step of a job: what it maps and reduces, and what is called around it."""

    mapper: Mapper
    reducer: Reducer
    setup: Hook | None = None
    cleanup: Hook | None = None

    def run(self, state: DataFrame, context: StepContext) -> DataFrame:
        return self.reducer(self.mapper(state, context), context)


def same_schema(before: DataFrame, after: DataFrame) -> None:
    kinds = lambda f: sorted((n, t) for n, t in f.dtypes)
    if kinds(before) != kinds(after):
        raise TypeError(f"a step must keep the schema {before.dtypes}; it made {after.dtypes}")


def run_steps(state: DataFrame, job: Sequence[Step], partitions: int | None = None, partitioner: Partitioner | None = None, key: str = "key", composable: bool = True, folder: str | None = None, name: str = "", on_step_end: Callable | None = None) -> DataFrame:
    """A chain of steps, each with its own mapper and reducer; each reads what the one before wrote.

    ``composable`` steps must keep the schema. With ``partitions`` every step reduces in so
    many partitions; ``partitioner(key, n)`` then says in which one the rows of a key are
    left. With ``folder`` the output of step k is kept there as ``name``/step-k, and a job
    that is run again goes on after the last step that was written whole.
    """
    spark = state.sparkSession
    if partitioner and not partitions:
        raise ValueError("a partitioner needs a number of partitions")
    place = f"{folder.rstrip('/')}/{name or 'job'}" if folder else None

    def output(frame: DataFrame, step: int, keep: Callable) -> DataFrame:
        if partitioner:
            frame = frame.repartitionById(partitions, partitioner(F.col(key), partitions).cast("int"))
        if not place:
            return keep(frame, "iterate")
        return table(spark, frame, f"{place}/step-{step}")

    done = 0
    while place and done < len(job) and exists(spark, f"{place}/step-{done + 1}/_SUCCESS"):
        done += 1
    if done:
        state = spark.read.parquet(f"{place}/step-{done}")
    with dealt_plans(spark, partitions) if partitions else nullcontext(), temporaries(spark) as keep_last:
        for s in range(done, len(job)):
            context, step = StepContext(s, len(job), name), job[s]
            if step.setup:
                step.setup(context)
            with temporaries(spark) as keep:
                after = step.run(state, context)
                if composable:
                    same_schema(state, after)
                state = output(after, s + 1, keep_last if s == len(job) - 1 else keep)
            if step.cleanup:
                step.cleanup(context)
            if on_step_end:
                on_step_end(context, state)
    return state


def iterate(state: DataFrame, mapper: Mapper, reducer: Reducer, steps: int, on_step_end: Callable | None = None, **job) -> DataFrame:
    """Each step maps and reduces the whole state; its output is the next one's input."""
    return run_steps(state, [Step(mapper, reducer)] * steps, on_step_end=on_step_end, **job)


def copartitioned(frame: DataFrame, key: str = "key", partitions: int | None = None) -> DataFrame:
    """A static relation dealt and sorted by key once; joins on the key don't move it again.

    It is cached: ``unpersist`` it when it is no longer read.
    """
    dealt = frame.repartition(partitions, key) if partitions else frame.repartition(key)
    return dealt.sortWithinPartitions(key).persist()


def merge_join(static: DataFrame, messages: DataFrame, key: str = "key", outer: bool = False) -> DataFrame:
    """Messages meet the static side; only messages move. ``outer`` keeps keys it lacks."""
    return static.join(messages, key, "full_outer" if outer else "left")


def buckets_of(frame: DataFrame, partitions: int | None) -> int:
    return partitions or int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def schimmy_iterate(static: DataFrame, state: DataFrame, mapper: Callable, reducer: Callable, steps: int, partitions: int | None = None, validate: Callable | None = None) -> DataFrame:
    """Steps that shuffle only messages; the static relation and the state stay in their buckets.

    ``mapper(static, state, context)`` makes messages with the state's columns, and
    ``reducer(state, messages, context)`` the next state. The result is the static
    relation joined with the last state.
    """
    spark = state.sparkSession
    n = buckets_of(state, partitions)
    with temporaries(spark) as keep, dealt_plans(spark, n):
        graph, states = Steps(spark, static.schema, n), Steps(spark, state.schema, n)
        try:
            static = graph.write(static, 0).drop("step")
            if validate:
                validate(static)
            now = states.write(state, 0).drop("step")
            for s in range(steps):
                context = StepContext(s, steps)
                messages = states.dealt(mapper(static, now, context), 0).drop("step")
                now = states.write(reducer(now, messages, context), s + 1).drop("step")
            return keep(merge_join(static, now), "schimmy")
        finally:
            graph.forget()
            states.forget()


def temporal_iterate(
    initial: DataFrame,
    mapper: Mapper,
    reducer: Reducer,
    steps: int,
    summarize: Callable | None = None,
    checkpoint=Never(),
    steps_filter: Callable | None = None,
    enforce_tnf: bool = False,
    on_step_end: Callable | None = None,
    combine: Callable[[DataFrame], DataFrame] | None = None,
    partitions: int | None = None,
    folder: str | None = None,
    setup: Hook | None = None,
    cleanup: Hook | None = None,
    validate: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Steps that map only the last one's changes, and reduce them with all history.

    The reducer gets (key, step, values, valid_from, valid_to, is_current): versions read
    from step k start at k, messages of step s at s + 1. It returns the changes; in the
    last step its output is the result. ``checkpoint`` chooses steps before which
    ``summarize`` makes one row of each key's versions. ``combine`` makes less of equal
    messages before they travel, and ``validate`` looks at the input once it is written.

    The input and all changes are written dealt by key into ``partitions`` buckets, where
    they stay: a step moves its messages alone. With ``folder`` these tables are kept, and
    a job that is run again goes on after the last step, or checkpoint, written whole.
    """
    if not isinstance(checkpoint, Never) and summarize is None:
        raise ValueError("checkpoints need summarize")
    if steps == 0:
        return initial
    spark = initial.sparkSession
    n = buckets_of(initial, partitions)
    with temporaries(spark) as keep, dealt_plans(spark, n):
        store = Steps(spark, initial.schema, n, folder=folder)
        try:
            done = store.last()
            if done is None:
                store.write(initial, 0)
            if validate and not done:
                validate(store.read(0).drop("step"))
            for s in range(min(done or 0, steps - 1), steps):
                context = StepContext(s, steps)
                if setup:
                    setup(context)
                if checkpoint.is_active(s) and not store.has(s, checkpoint=True):
                    store.write(summarize(store.history(s, checkpoint.last(s, inclusive=False))), s, checkpoint=True)
                history = store.history(s, checkpoint.last(s, inclusive=store.reads_own_checkpoint))
                if steps_filter:
                    history = history.filter(steps_filter(F.col("step")))
                messages = mapper(store.read(s).drop("step"), context)
                messages = store.dealt(combine(messages) if combine else messages, s + 1)
                out = reducer(validity(history.unionByName(messages)), context)
                if enforce_tnf and not context.is_last_step:
                    out = changed(history, out)
                delta = keep(out, "result") if context.is_last_step else store.write(out, s + 1).drop("step")
                if on_step_end:
                    on_step_end(context, delta)
                if cleanup:
                    cleanup(context)
            return delta
        finally:
            store.forget()


def changed(history: DataFrame, delta: DataFrame) -> DataFrame:
    """Rows of ``delta`` that differ from their key's latest version."""
    values = [c for c in delta.columns if c != "key"]
    newest = Window.partitionBy("key").orderBy(F.desc("step"))
    latest = history.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").select("key", F.struct(*values).alias("_was"))
    return delta.join(latest, "key", "left").filter(F.col("_was").isNull() | ~F.col("_was").eqNullSafe(F.struct(*values))).select(*delta.columns)
