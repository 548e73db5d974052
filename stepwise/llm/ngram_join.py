"""N-gram Jaccard self-join by chosen paths.

Texts are sets of five-word shingles; two are linked at a Jaccard similarity of 0.8 or
more. Every set is embedded as a list of MinHash tokens, of which two sets share each with
a probability equal to their similarity. A run sends every set down a path of sampled
tokens: sets that share the token of a bucket meet in it. Small buckets are compared by
brute force. A large one splits on further sampled tokens, three for each set, so that
similar sets go on together while others part (no run starts from these tokens); but a bucket whose sets are alike on
average, which no token would part, is compared in blocks: each block is packed into one
row, and what a pair of blocks finds is packed likewise, so that rows of sets don't multiply
with the blocks of their bucket. Runs repeat until a pair at the
threshold is met with the target recall. Comparing by brute force first counts the tokens
that two sets share, and then intersects the full sets where these are not far too few for
the threshold; links are decided on the full sets alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_blocks, with_groups, written
from .grams import mixed, word_hashes, words

SHINGLE = 5
#: The similarity as a fraction of whole numbers: 4 / 5.
SIMILAR = (4, 5)
RECALL = 0.999
TOKENS = 24
#: Largest bucket for one comparison, sets in a block, tokens by which a bucket splits.
SMALL, BLOCK, BRANCHES = 400, 800, 3
DEPTH, DENSE = 8, 0.5
#: Two sets with fewer equal tokens are not compared any further. Pairs at the threshold have
#: so few with a probability of seven in a million.
AGREEING = 10
#: Texts of one comparison have about so many bytes together, but for two longer ones.
TASK_BYTES = 1 << 24
LEADERS = 3
INSIDE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


def meeting(depth: int = DEPTH) -> float:
    """The least probability that one run brings a pair at the threshold together.

    The pair shares the run's first token, and, where buckets split ``depth`` times, at each
    split one of the tokens at least on which it is met further down.
    """
    share, further = SIMILAR[0] / SIMILAR[1], 1.0
    for _ in range(depth):
        further = 1 - (1 - share * further) ** BRANCHES
    return share * further


def runs(recall: float = RECALL, depth: int = DEPTH) -> int:
    """A pair at the threshold misses all runs with probability (1 - meeting) ** runs.

    Runs start from tokens of their own, which no split uses; so many must be there.
    """
    count = max(1, math.ceil(math.log(1 - recall) / math.log(1 - meeting(depth))))
    if count + depth + BRANCHES - 1 > TOKENS:
        raise ValueError(f"a recall of {recall} takes {count} runs, too many for {TOKENS} tokens")
    return count


def shingles(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes and their rows, by row; also word hashes and their rows.

    A text of fewer than five words is one shingle of all its words.
    """
    begin, end, row = words(data, starts, INSIDE)
    code = word_hashes(data, begin, end)
    last = len(code) - SHINGLE + 1
    if last > 0:
        made = np.zeros(last, np.uint64)
        for k in range(SHINGLE):
            made = made * np.uint64(0x9E3779B97F4A7C15) + code[k : last + k]
        whole = row[:last] == row[SHINGLE - 1 :]
        made, of = mixed(made[whole]), row[:last][whole]
    else:
        made, of = np.empty(0, np.uint64), np.empty(0, np.int32)
    size = np.bincount(row, minlength=len(starts) - 1)
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    if len(short):
        at = np.searchsorted(row, short)
        extra = np.array([xxhash.xxh3_64_intdigest(code[a : a + size[r]].tobytes()) for a, r in zip(at.tolist(), short.tolist(), strict=True)], np.uint64)
        made, of = np.concatenate([made, extra]), np.concatenate([of, short.astype(np.int32)])
        order = np.argsort(of, kind="stable")
        made, of = made[order], of[order]
    return made, of, code, row


def embedded(batches):
    """A mapInArrow function: (doc_id, mark, text) -> identity of the words, and MinHash tokens."""
    salts = np.random.default_rng(24).integers(1, 1 << 63, (TOKENS, 2), dtype=np.uint64) | np.uint64(1)
    for batch in batches:
        for lo, hi, data, starts in text_blocks(batch.column(2)):
            n = hi - lo
            made, of, code, row = shingles(data, starts)
            tokens = np.zeros((n, TOKENS), np.int32)
            if len(made):
                there, first = np.unique(of, return_index=True)
                for k, (salt, odd) in enumerate(salts):
                    least = np.minimum.reduceat((made ^ salt) * odd, first)
                    tokens[there, k] = (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
            bounds = np.searchsorted(row, np.arange(n + 1)).tolist()
            raw = code.tobytes()
            keys = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) if b > a else None for a, b in zip(bounds, bounds[1:], strict=False)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * TOKENS, TOKENS), pa.int32()), pa.array(tokens.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(keys, pa.binary()), pa.array(np.diff(starts), pa.int64()), lists], ["doc_id", "mark", "words", "bytes", "tokens"])


def mark(text: Column) -> Column:
    """With the id, finds a row's text again."""
    return F.xxhash64(text, F.octet_length(text))


def branch(nodes: DataFrame, path: Column, used: Column, branches: int) -> DataFrame:
    """One bucket for each of the tokens that the path samples: (path, node, bytes, used)."""
    free = F.filter(F.sequence(F.lit(0), F.lit(TOKENS - 1)), lambda i: ~F.array_contains(used, i))
    order = F.array_sort(F.transform(free, lambda i: F.struct(F.xxhash64(path, i).alias("h"), i.alias("i"))))
    chosen = nodes.select("node", "bytes", "tokens", path.alias("from"), used.alias("was"), F.explode(F.slice(order, 1, branches)).alias("c"))
    token = F.col("tokens")[F.col("c.i")]
    return chosen.select(F.xxhash64("from", "c.i", token).alias("path"), "node", "bytes", F.concat("was", F.array("c.i")).alias("used"))


def buckets(spark: SparkSession, nodes: DataFrame, recall: float = RECALL, small: int = SMALL, block: int = BLOCK, depth: int = DEPTH, most: int = TASK_BYTES) -> DataFrame:
    """What to compare: (task, path, node, side, sides) from ``nodes`` (node, tokens, bytes if known).

    A row for each node and path. Within a task, every two nodes are compared. Where a path
    has several sides, each a task, so are every two nodes of the path across its sides.
    """
    if "bytes" not in nodes.columns:
        nodes = nodes.withColumn("bytes", F.lit(0).cast("long"))
    # Run r starts from token r; the tokens of all starts are used up for splits.
    starts = list(range(runs(recall, depth)))
    used = F.array(*[F.lit(r) for r in starts])
    first = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.col("tokens")[r].alias("token")) for r in starts]))
    rows = nodes.select("node", "bytes", first.alias("c")).select(F.xxhash64(F.lit("run"), "c.run", "c.token").alias("path"), "node", "bytes", used.alias("used"))
    tasks = []
    for level in range(depth + 1):
        sized = rows.groupBy("path").agg(F.count("*").alias("n"), F.sum("bytes").alias("total")).filter("n > 1")
        rows = written(spark, with_groups(rows, written(spark, sized, "path-sizes"), "path", "n"), "paths")
        # Small buckets are gathered, whose size is bounded; equal ones are compared once.
        fits = (F.col("n") <= small) & (F.col("total") <= most)
        few = rows.filter(fits).groupBy("path").agg(F.array_sort(F.collect_list("node")).alias("members"))
        few = few.groupBy("members").agg(F.min("path").alias("path"))
        # Written level by level: one plan of all would keep the driver busy with all at once.
        few = few.select(F.col("path").alias("task"), "path", F.explode("members").alias("node"), F.lit(0).alias("side"), F.lit(1).alias("sides"))
        tasks.append(written(spark, few, "tasks"))
        large = rows.filter(~fits)
        if large.limit(1).count() == 0:
            break
        large = written(spark, large.join(nodes.select("node", "tokens"), "node"), "large-paths")
        dense = F.lit(True)
        if level < depth:
            # The mean similarity of a bucket's sets to some of its members, chosen by hash. Of
            # these there are few rows, one for each large bucket.
            leaders = large.groupBy("path").agg(*[F.min_by("tokens", F.xxhash64("node", F.lit(k))).alias(f"leader{k}") for k in range(LEADERS)])
            same = sum(F.size(F.filter(F.zip_with("tokens", f"leader{k}", lambda x, y: x == y), lambda x: x)) for k in range(LEADERS))
            alike = large.join(leaders, "path").groupBy("path").agg((F.avg(same) / (LEADERS * TOKENS)).alias("alike"))
            large = written(spark, large.join(alike, "path"), "alike-paths")
            dense = F.col("alike") >= DENSE
        tasks.append(blocks(large.filter(dense), block, most))
        if level == depth or large.filter(~dense).limit(1).count() == 0:
            break
        rows = branch(large.filter(~dense), F.col("path"), F.col("used"), BRANCHES)
    out = tasks[0]
    for part in tasks[1:]:
        out = out.unionByName(part)
    return out


def blocks(rows: DataFrame, block: int, most: int = TASK_BYTES) -> DataFrame:
    """Deal the nodes of a bucket into blocks: its sides, each a task.

    A block has ``block`` sets, and half of ``most`` bytes, on average.
    """
    parts = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("total") * 2 / most)).cast("int")
    side = F.pmod(F.xxhash64("node"), F.col("sides").cast("long")).cast("int")
    dealt = rows.select("path", "node", parts.alias("sides")).withColumn("side", side)
    return dealt.select(F.xxhash64("path", "side").alias("task"), "path", "node", "side", "sides")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    out = np.zeros((n, n), np.float32)
    # No wider than the shingles that are shared: most comparisons are of a few sets.
    step = min(max(1024, (1 << 23) // n), max(1, int(shared.sum())))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, [lo, lo + step])
        part = np.zeros((n, step), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        out += part @ part.T
    return out.astype(np.int64)


def linked(sets: list[np.ndarray], side: np.ndarray) -> np.ndarray:
    """Which of the sets are similar: a symmetric matrix."""
    size = np.array([len(s) for s in sets])
    common = overlaps(sets)
    out = SIMILAR[1] * common >= SIMILAR[0] * (size[:, None] + size[None] - common)
    out &= ((side[:, None] != side[None]) | (side[:, None] == 0)) & (size[:, None] > 0)
    np.fill_diagonal(out, False)
    return out


def stars(links: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component."""
    label = np.arange(len(links))
    while True:
        near = np.where(links, label[None], len(links)).min(1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def met_before(paths: list[list[int]], path: int) -> np.ndarray:
    """Which two of the nodes are both on a path that comes before ``path``."""
    before = {p: k for k, p in enumerate({p for x in paths for p in x if p < path})}
    on = np.zeros((len(paths), len(before)), np.float32)
    for i, x in enumerate(paths):
        on[i, [before[p] for p in x if p < path]] = 1
    return on @ on.T > 0


def agreeing(tokens: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which two of the nodes have tokens enough in common, and are to be compared: a symmetric matrix."""
    same = np.zeros((len(tokens), len(tokens)), np.uint8)
    for column in tokens.T:
        same += column[:, None] == column[None]
    out = (same >= AGREEING) & ((side[:, None] != side[None]) | (side[:, None] == 0))
    np.fill_diagonal(out, False)
    return out


def parted(table: pa.Table) -> pa.Table:
    """An applyInArrow function on the rows of one task: the parts in which links may lie.

    Nodes that agree with none are left out; the others get the smallest member of their
    component in ``part``.
    """
    tokens = table.column("tokens").combine_chunks()
    may = agreeing(tokens.flatten().to_numpy().reshape(len(table), TOKENS), np.zeros(len(table), int))
    node = table.column("node").to_numpy()
    there = pa.array(np.flatnonzero(may.any(1)))
    out = table.select(["task", "path", "node"]).take(there)
    return out.append_column("part", pa.array(node[stars(may)], pa.int64()).take(there))


def hashed(texts: pa.ChunkedArray) -> list[np.ndarray]:
    """The set of shingles of each text, in order."""
    sets: list[np.ndarray] = []
    for lo, hi, data, starts in text_blocks(texts):
        made, of, _, _ = shingles(data, starts)
        bounds = np.searchsorted(of, np.arange(hi - lo + 1))
        sets += [np.unique(made[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    return sets


def star_id(of: int, node: int) -> int:
    """The number of the star around a node in a task or on a path."""
    return xxhash.xxh3_64_intdigest(f"{of}:{node}") >> 1


def compared(table: pa.Table) -> pa.Table:
    """An applyInArrow function on the rows of one task: links of each node, and its star.

    Two nodes may meet on several paths; their link counts on the first that both are on.
    """
    node = table.column("node").to_pylist()
    task, path = table.column("task")[0].as_py(), table.column("path")[0].as_py()
    links = linked(hashed(table.column("text")), np.zeros(len(node), int))
    count = (links & ~met_before(table.column("paths").to_pylist(), path)).sum(1).tolist()
    star = stars(links)
    found = np.flatnonzero(links.any(1)).tolist()
    return pa.table({"node": pa.array([node[i] for i in found], pa.int64()), "star": pa.array([star_id(task, node[star[i]]) for i in found], pa.int64()), "links": pa.array([count[i] for i in found], pa.int64())})


PACKED = "path long, side int, sides int, node array<long>, paths array<array<long>>, tokens array<int>, sizes array<int>, sets binary"
FOUND = "path long, side int, node array<long>, head array<long>, links array<long>"


def packed(table: pa.Table) -> pa.Table:
    """An applyInArrow function on the rows of one block: the block as one row (``PACKED``)."""
    table = table.sort_by("node")
    sets = hashed(table.column("text"))
    tokens = table.column("tokens").combine_chunks().flatten()
    one = {k: table.column(k)[:1].combine_chunks() for k in ("path", "side", "sides")}
    one |= {"node": pa.array([table.column("node").to_numpy()], pa.list_(pa.int64())), "paths": pa.array([table.column("paths").to_pylist()], pa.list_(pa.list_(pa.int64())))}
    one |= {"tokens": pa.array([tokens.to_numpy()], pa.list_(pa.int32())), "sizes": pa.array([[len(s) for s in sets]], pa.list_(pa.int32()))}
    return pa.table(one | {"sets": pa.array([np.concatenate(sets).tobytes()], pa.binary())})


def across(table: pa.Table) -> pa.Table:
    """An applyInArrow function on a pair of packed blocks, or one block by itself (``FOUND``).

    A row for each block: its nodes, the smallest node of each one's component (-1 where
    it has no link), and the links that count here, as in ``compared``.
    """
    rows = table.to_pylist()
    one = rows[0]["low"] == rows[0]["high"]
    if len(rows) == 1 and not one:  # no node was dealt into the other block
        rows = []
    path = rows[0]["path"] if rows else 0
    size = [len(r["node"]) for r in rows]
    side = np.repeat(np.arange(len(rows)) + (0 if one else 1), size)
    node = np.array([x for r in rows for x in r["node"]], np.int64)
    tokens = np.array([x for r in rows for x in r["tokens"]], np.int32).reshape(len(node), TOKENS)
    sets = [s for r in rows for s in np.split(np.frombuffer(r["sets"], np.uint64), np.cumsum(r["sizes"])[:-1])]
    may = agreeing(tokens, side)
    part = np.where(may.any(1), stars(may), -1) if rows else node
    links = np.zeros((len(node), len(node)), bool)
    for p in np.unique(part[part >= 0]):
        at = np.flatnonzero(part == p)
        links[np.ix_(at, at)] = linked([sets[i] for i in at], side[at])
    count = (links & ~met_before([x for r in rows for x in r["paths"]], path)).sum(1)
    head = np.where(links.any(1), node[stars(links)], -1) if rows else node
    ends = np.cumsum(size).tolist()
    cut = [slice(b - n, b) for n, b in zip(size, ends, strict=True)]
    lists = {k: pa.array([v[c] for c in cut], pa.list_(pa.int64())) for k, v in (("node", node), ("head", head), ("links", count))}
    return pa.table({"path": pa.array([path] * len(rows), pa.int64()), "side": pa.array([r["side"] for r in rows], pa.int32())} | lists)


def gathered(table: pa.Table) -> pa.Table:
    """An applyInArrow function on all that was found of one block: links of each node, and its star.

    Nodes with a head in common, directly or through others, get one star; their other
    heads' stars are tied to it by a row without links.
    """
    path = table.column("path")[0].as_py()
    node = table.column("node")[0].values.to_numpy()
    links = np.sum([x.values.to_numpy() for x in table.column("links")], axis=0)
    heads = np.stack([x.values.to_numpy() for x in table.column("head")])
    none = np.iinfo(np.int64).max
    heads[heads < 0] = none
    value, first, at = np.unique(heads, return_index=True, return_inverse=True)
    at, least = at.reshape(heads.shape), value
    while True:
        label = least[at].min(0)
        new = np.full(len(value), none)
        np.minimum.at(new, at, np.broadcast_to(label, heads.shape))
        new[value == none] = none
        if (new == least).all():
            break
        least = new
    found = np.flatnonzero(label != none)
    tied = np.flatnonzero(least != value)
    stars_of = [*label[found].tolist(), *value[tied].tolist()]
    nodes = np.concatenate([node[found], node[first[tied] % len(node)]])
    return pa.table({"node": pa.array(nodes, pa.int64()), "star": pa.array([star_id(path, h) for h in stars_of], pa.int64()), "links": pa.array(np.concatenate([links[found], np.zeros(len(tied), np.int64)]), pa.int64())})


def components(spark: SparkSession, joined: DataFrame) -> DataFrame:
    """(node, component) from ``joined`` (node, star): nodes of one star are connected.

    Labels pass from nodes to stars and back, and follow each other's labels, until none
    changes; all of it in tables.
    """
    label = written(spark, joined.select("node", F.col("node").alias("component")).distinct(), "labels")
    while True:
        least = joined.join(label, "node").groupBy("star").agg(F.min("component").alias("component"))
        new = joined.join(least, "star").groupBy("node").agg(F.min("component").alias("component"))
        # A label is a node, whose own label so far is taken if it is smaller.
        further = label.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = new.join(further, "component").join(label.withColumnRenamed("component", "before"), "node")
        new = written(spark, new.select("node", F.least("component", "further").alias("component"), "before"), "labels")
        label = new.drop("before")
        if not new.filter("component != before").limit(1).count():
            return label


def near_copies(spark: SparkSession, docs: DataFrame, recall: float = RECALL, **sizes) -> DataFrame:
    """Classes of near copies among ``docs`` (doc_id, text).

    Returns a row per input row: doc_id, class_id (the smallest doc_id that links connect
    it to), copies (rows with the same words in the same order, itself included), n_links
    (different texts at the similarity or above) and kept (one row of each class, that of
    the smallest id). Null and empty texts and those without words have no shingles and
    stand alone; texts under five words are one shingle. Null ids come last; of rows that
    repeat an id any one is kept. Other columns are ignored; no rows give no rows.
    """
    return classes(spark, docs, recall, **sizes).drop("mark")


def classes(spark: SparkSession, docs: DataFrame, recall: float = RECALL, **sizes) -> DataFrame:
    """What ``near_copies`` returns, with each row's mark."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    asked = slim.select("doc_id", mark(F.col("text")).alias("mark"), "text")
    made = asked.mapInArrow(embedded, "doc_id long, mark long, words binary, bytes long, tokens array<int>").withColumn("row", F.monotonically_increasing_id())
    made = written(spark, made, "shingles")
    # One row for each different text: that of its first row, which stands for all its copies.
    first = F.min(F.struct("row", "doc_id", "mark", "bytes", "tokens"))
    texts = made.filter(F.col("words").isNotNull()).groupBy("words").agg(first.alias("first"), F.count("*").alias("copies"))
    nodes = written(spark, texts.select("words", "copies", F.col("first.row").alias("node"), "first.doc_id", "first.mark", "first.bytes", "first.tokens"), "different-texts")
    tasks = written(spark, buckets(spark, nodes.select("node", "tokens", "bytes"), recall, **sizes), "all-tasks")
    apart = tasks.filter("sides > 1")
    parts = tasks.filter("sides = 1").join(nodes.select("node", "tokens"), "node").groupBy("task").applyInArrow(parted, "task long, path long, node long, part long")
    tasks = written(spark, parts.select(F.xxhash64("task", "part").alias("task"), "path", "node"), "parts")
    on = tasks.select("node", "path").unionByName(apart.select("node", "path")).distinct().groupBy("node").agg(F.collect_list("path").alias("paths"))
    wanted = nodes.join(on, "node").select("node", "paths", "tokens", *named(F.col("doc_id")), "mark")
    keys = ["unnamed", "id", "mark"]
    full = slim.select(*named(F.col("doc_id")), mark(F.col("text")).alias("mark"), "text").join(wanted, keys)
    full = full.dropDuplicates([*keys, "node"]).select("node", "paths", "tokens", "text")
    schema = "node long, star long, links long"
    links = tasks.join(full.drop("tokens"), "node").groupBy("task").applyInArrow(compared, schema)
    if apart.limit(1).count():
        rows = apart.join(full, "node").groupBy("task").applyInArrow(packed, PACKED)
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
        rows = rows.withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")}).drop("other", "sides")
        found = rows.groupBy("path", "low", "high").applyInArrow(across, FOUND)
        links = links.unionByName(found.groupBy("path", "side").applyInArrow(gathered, schema))
    links = written(spark, links, "links")
    counts = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    label = components(spark, links.select("node", "star").distinct())
    none = F.lit(0).cast("long")
    each = nodes.select("words", "copies", "node").join(counts, "node", "left").join(label, "node", "left")
    each = each.select("words", "copies", F.coalesce("n_links", none).alias("n_links"), F.coalesce("component", "node").alias("component"))
    rows = made.select("row", "doc_id", "mark", "words")
    alone = rows.filter(F.col("words").isNull()).select("*", F.lit(1).cast("long").alias("copies"), none.alias("n_links"), F.col("row").alias("component"))
    out = written(spark, with_groups(rows, written(spark, each, "text-classes"), "words", "copies").unionByName(alone).drop("words"), "classes")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    heads = out.groupBy("component").agg(least.alias("head"), F.count("*").alias("members"))
    out = with_groups(out, written(spark, heads, "class-heads"), "component", "members")
    return out.select("doc_id", F.col("head.doc_id").alias("class_id"), "copies", "n_links", (F.col("row") == F.col("head.row")).alias("kept"), "mark")


def named(doc_id: Column) -> tuple[Column, Column]:
    """The id in two columns without nulls, to join on."""
    return doc_id.isNull().alias("unnamed"), F.coalesce(doc_id.cast("long"), F.lit(0).cast("long")).alias("id")


def without_near_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``near_copies`` keeps, with all their columns.

    Of rows that repeat both id and text one stays, whichever. Texts without words are kept,
    one of each id and text; a null id is an id of its own and the largest. No rows give no
    rows. Columns of ``docs`` are returned as they are; their names can't clash.
    """
    keys = ["unnamed", "id", "mark"]
    kept = classes(spark, docs).filter("kept").select(*named(F.col("doc_id")), "mark")
    rows = docs.select(*named(F.col("doc_id")), mark(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("mark"), F.struct("*").alias("row"))
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys).select("row.*")
