"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue: its documents in an order shuffled by their hash, repeated in
rounds as long as the target asks for. What is served at a time is a document, or a part
of it where it is long. A part's virtual finish time is the number of its source's words up
to its end, divided by the source's target; serving all queues by finish time keeps them in
step with their weights at every moment. Parts are dealt out by ranges of finish time;
running sums over the ranges tell in which one the total budget is spent, that one is
sorted, and the mix is cut at the word where the budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, sharing, with_groups, written

WEIGHTS = (5, 2, 1)
MOST_ROUNDS = 3
#: Words that are served at a time.
PART = 64
#: The least number of ranges of finish time up to 1, when all queues reach their targets.
RANGES = 4096
#: Documents are shuffled by the first 60 bits of a digest of this seed and their id.
SEED = "mix-1"


def word_count(text: Column | str = "text") -> Column:
    """The number of runs of characters that are not ASCII white space."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A digest that tells sources apart, null too."""
    return F.sha2(F.coalesce(F.concat(F.lit("+"), source), F.lit("-")), 256)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_ROUNDS) -> DataFrame:
    """Each source's share of the total size by its weight, none above ``most`` times its size.

    ``sources`` (source, source_size, ...) gains queue, its place in code point order, null
    last, and target. Sources weigh ``weights`` in turn. What a source can't take is shared
    again by weight among the others: every pass over the table raises the common level,
    until no other source is full. Sources stay in tables, however many there are.
    """
    spark = sources.sparkSession
    order = [F.col("source").isNull(), F.col("source")]
    dealt = sources.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranked = numbered(written(spark, dealt.withColumn("one", F.lit(1).cast("long")), "mix-sources"), [], order, "range", {"queue": "one"})
    own = F.element_at(F.array(*map(F.lit, weights)), (F.col("queue") % len(weights) + 1).cast("int")).cast("long")
    ranked = written(spark, ranked.withColumn("weight", own).drop("one", "range"), "mix-ranks")
    size = F.col("source_size")
    budget, weight = ranked.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    total, every = budget, weight
    while True:
        full = size * most * weight <= F.col("weight") * budget
        taken, there = ranked.filter(full).agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if (total - most * taken, every - there) == (budget, weight) or every == there:
            break
        budget, weight = total - most * taken, every - there
    level = float(budget) / weight if weight else 0.0
    return ranked.withColumn("target", F.when(full, (size * most).cast("double")).otherwise(F.col("weight") * F.lit(level))).drop("weight")


def shuffle_key(doc_id: Column | str = "doc_id", seed: str = SEED) -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def slim(docs: DataFrame, seed: str = SEED) -> DataFrame:
    source = F.col("source").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), source_key(source).alias("of"), word_count().alias("size"), shuffle_key(seed=seed).alias("key"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_ROUNDS, seed: str = SEED) -> DataFrame:
    """How many words of each document of ``docs`` (doc_id, text, source) the mix takes.

    Returns doc_id, source, size, source_size, target (its source's), taken, and
    ``before``, the words of its queue ahead of it in one round. Null texts have no words;
    a null source is a source of its own and comes last; a document without words takes
    none. Rows with equal ids stand next to each other in their queue. The same rows give
    the same mix again. No rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = written(spark, slim(docs, seed), "mix-sizes")
    queue = written(spark, queued(rows, sources(rows, weights, most)), "mix-queues")
    taken = F.aggregate(turns(most, spent(queue, most)), F.lit(0).cast("long"), lambda a, x: a + x["taken"])
    return queue.withColumn("taken", taken).select("doc_id", "source", "size", "source_size", "target", "taken", "before")


def sources(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_ROUNDS) -> DataFrame:
    """The queues of ``rows``: of, n, source_size, queue, target."""
    known = rows.groupBy("source", "of").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    return written(rows.sparkSession, targets(known, weights, most).drop("source"), "mix-targets")


def queued(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Line ``rows`` (of, doc_id, size, key, ...) up: adds n, source_size, queue, target and before."""
    # A queue has as many parts as its documents ask for, by the leading part of the key.
    parts = sharing(known.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0], least=64)
    frame = with_groups(rows, known, "of", "n").withColumn("part", F.floor(F.col("key") / F.lit(float(1 << 60)) * parts).cast("int"))
    return numbered(frame, ["queue"], ["key", "doc_id", "size"], "part", {"before": "size"})


def parts(most: int) -> Column:
    """What is served of a document, by round: array of (round, end, words, finish)."""
    size = F.col("size")
    first = F.when(size > 0, F.sequence(F.lit(0).cast("long"), size - 1, F.lit(PART).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def part(k: int):
        def made(at: Column) -> Column:
            end = F.least(at + PART, size)
            place = F.col("source_size") * k + F.col("before") + end
            return F.struct(F.lit(k).alias("round"), place.alias("place"), (end - at).alias("words"), (place / F.col("target")).alias("finish"))

        return made

    return F.concat(*[F.transform(first, part(k)) for k in range(most)])


def spent(queue: DataFrame, most: int = MOST_ROUNDS) -> tuple[float, int, int, int] | None:
    """Where the total budget is spent: finish, queue and place of the part that is cut, and its words taken.

    The budget is the size of all documents. None if there are no words.
    """
    budget, rows = queue.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not budget:
        return None
    ranges = max(RANGES, sharing(rows))
    served = queue.select("queue", F.explode(parts(most)).alias("x")).select("queue", "x.*")
    # Nearly all of what comes after time 1 is beyond the budget, and so are later ranges as one.
    served = served.withColumn("range", F.least(F.floor(F.col("finish") * ranges), F.lit(2 * ranges)))
    running = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = served.groupBy("range").agg(F.sum("words").alias("words"))
    # One row for each range.
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(running("range")), F.lit(0)))
    found, before = sums.filter((F.col("before") < budget) & (F.col("before") + F.col("words") >= budget)).select("range", "before").first()
    last = served.filter(F.col("range") == found)
    # The range in which the budget ends, about one in ``ranges`` of all words.
    last = last.withColumn("before", F.lit(before) + F.coalesce(F.sum("words").over(running("finish", "queue", "place")), F.lit(0)))
    cut = last.filter((F.col("before") < budget) & (F.col("before") + F.col("words") >= budget)).first()
    return cut["finish"], cut["queue"], cut["place"], budget - cut["before"]


def turns(most: int, cut: tuple[float, int, int, int] | None) -> Column:
    """By round, what the mix takes of a document and when its turn ends: array of (round, taken, finish)."""
    finish, queue, place, left = cut or (-1.0, -1, -1, 0)
    order = F.struct(F.lit(finish).alias("finish"), F.lit(queue).cast("long").alias("queue"), F.lit(place).cast("long").alias("place"))

    def words(x: Column) -> Column:
        own = F.struct(x["finish"].alias("finish"), F.col("queue").cast("long").alias("queue"), x["place"].alias("place"))
        return F.when(own < order, x["words"]).when(own == order, F.lit(left).cast("long")).otherwise(F.lit(0).cast("long"))

    def turn(k: int) -> Column:
        own = F.filter(parts(most), lambda x: x["round"] == k)
        end = (F.col("source_size") * k + F.col("before") + F.col("size")) / F.col("target")
        return F.struct(F.lit(k).alias("round"), F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + words(x)).alias("taken"), end.alias("finish"))

    return F.array(*[turn(k) for k in range(most)])


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_ROUNDS, seed: str = SEED) -> DataFrame:
    """The documents of the mix themselves, as often as it takes them, in order of their finish.

    A turn that is cut by the end of the budget counts if at least half of it is served.
    The order is global: by ranges of finish times over tasks, sorted in each. Null texts
    and texts without words are never served; a null source is a source of its own; rows
    that repeat are documents of their own; no rows give no rows. Columns of ``docs`` are
    returned as they are; their names can't clash.
    """
    spark = docs.sparkSession
    rows = written(spark, slim(docs, seed), "mix-sizes")
    known = sources(rows, weights, most)
    cut = spent(queued(rows, known), most)
    whole = docs.select(F.struct("*").alias("row")).select("row", F.struct(*[F.col(f"row.{c}").alias(c) for c in ("doc_id", "text", "source")]).alias("d"))
    whole = whole.select("row", F.col("d.doc_id").cast("long").alias("doc_id"), source_key(F.col("d.source").cast("string")).alias("of"), word_count(F.col("d.text")).alias("size"), shuffle_key(F.col("d.doc_id"), seed).alias("key"))
    served = queued(whole, known).select("row", "key", "size", F.explode(turns(most, cut)).alias("turn"))
    mixed = served.filter((F.col("size") > 0) & (F.col("turn.taken") * 2 >= F.col("size")))
    return mixed.repartitionByRange("turn.finish", "key").sortWithinPartitions("turn.finish", "key").select("row.*")
