"""Packing by minimum bin slack over the histogram of remaining lengths.

Documents are tokenised once. Whole windows are sequences already; what remains of a
document (below one window) is described by its length alone, so the packing problem is
the histogram of those lengths: at most ``capacity - 1`` numbers, whatever the corpus.
On it, windows are filled one *pattern* at a time: the longest length left opens the
window, bitset subset sums over the bounded multiset of the other lengths show every
reachable fill, the fill closest to capacity is backtracked to counts, and the pattern is
repeated as often as the histogram allows. Where no fill reaches capacity, one length is
cut for all repeats to close the gap. The plan is a small table of rank ranges by length;
every document finds its place from its length and its rank among equals.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, sharing, worker_cache, written

CAPACITY = 1024
END = 0
#: Letters of the fast path; a text with any other sign goes to the tokenizer whole.
LETTERS = "A-Za-zÀ-ÖØ-öø-ʯ"
WORDS_KEPT = 200_000


class Words(dict):
    """Piece of text -> its token ids as little-endian bytes; two generations bound its size."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in printed]
        self.shown = {b: b for b in printed} | {b: 256 + i for i, b in enumerate(hidden)}
        self.older: dict = {}
        self.piece = re.compile(rf" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+").findall
        # Signs beyond the fast path; added tokens stand for themselves wherever they are.
        self.other = re.compile(rf"[^\t\n\r\x20-\x7e{LETTERS}]").search
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            word = piece.encode().decode("latin-1").translate(self.shown)
            ids = packed(x.id for x in self.model.tokenize(word))
        if len(piece) <= 64:
            if len(self) >= WORDS_KEPT:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if self.other(text) or any(x in text for x in self.added):
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, self.piece(text)))


def packed(ids) -> bytes:
    out = array("I", ids)
    if out.itemsize != 4:
        raise TypeError("unsigned int has not 4 bytes here")
    return out.tobytes()


def tokenised(path: str, capacity: int, salts: int):
    """A mapInArrow function: per row the ids' number, checksums of whole windows, and the rest."""

    def run(batches):
        cache = worker_cache("packing")
        words = cache.get(path) or cache.setdefault(path, Words(path))
        end = packed([END])
        step = 4 * capacity
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, len(texts), 512):
                n, full, rest, salt = [], [], [], []
                for text in texts.slice(lo, 512).to_pylist():
                    ids = words.ids(text or "") + end
                    whole = len(ids) // step
                    n.append(len(ids) // 4)
                    full.append([zlib.crc32(ids[i * step : (i + 1) * step]) for i in range(whole)])
                    rest.append(ids[whole * step :])
                    salt.append(len(salt) * 7919 + zlib.crc32(ids))
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(rest, pa.binary()), pa.array([(x * 2654435761 >> 7) % salts for x in salt], pa.int32())],
                    ["doc_id", "doc_tokens", "full", "rest", "salt"],
                )

    return run


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The sub-multiset of ``counts`` with the largest sum up to ``room``.

    Reachable sums are the bits of one integer. A length available k times enters as
    chunks of 1, 2, 4, ... copies; the states before each chunk are kept and walked back.
    """
    full = (1 << room + 1) - 1
    reach, states = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        size = 1
        while left > 0:
            take = min(size, left)
            states.append((length, take, reach))
            reach |= reach << length * take & full
            left -= take
            size *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(states):
        if before >> total & 1:
            continue
        used[length] = used.get(length, 0) + take
        total -= length * take
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list], int]:
    """From lengths and their counts, where each rank of each length goes.

    Returns rules and the number of sequences. Rules of a length, by first rank:
    ("put", first, end, copies in a window, first sequence, offset of the first copy) or
    ("cut", first, end, left length, its first rank, right length, its first rank).
    Lengths are below ``capacity``; every rank of every length has exactly one rule.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    first = {k: 0 for k in left}
    rules: dict[int, list] = {}
    sequence = 0

    def add(length: int, number: int) -> int:
        at = first.get(length, 0) + left.get(length, 0)
        first.setdefault(length, 0)
        left[length] = left.get(length, 0) + number
        return at

    def take(length: int, number: int) -> int:
        at = first[length]
        first[length] += number
        left[length] -= number
        if not left[length]:
            del left[length]
        return at

    def cut(length: int, number: int, part: int) -> None:
        at = take(length, number)
        a = add(part, number)
        b = add(length - part, number)
        rules.setdefault(length, []).append(("cut", at, at + number, part, a, length - part, b))

    def put(pattern: dict[int, int], repeats: int) -> None:
        nonlocal sequence
        offset = 0
        for length in sorted(pattern, reverse=True):
            at = take(length, pattern[length] * repeats)
            rules.setdefault(length, []).append(("put", at, at + pattern[length] * repeats, pattern[length], sequence, offset))
            offset += length * pattern[length]
        sequence += repeats

    def remaining() -> int:
        return sum(k * v for k, v in left.items())

    while left and remaining() >= capacity:
        longest = max(left)
        others = dict(left)
        others[longest] -= 1
        if not others[longest]:
            del others[longest]
        pattern = best_fill(others, capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        gap = capacity - sum(k * v for k, v in pattern.items())
        repeats = min(left[k] // v for k, v in pattern.items())
        if gap:
            # Every length left beside the pattern is above the gap: cut the commonest.
            spare = {k: v - pattern.get(k, 0) for k, v in left.items() if k > gap and v > pattern.get(k, 0)}
            length = max(spare, key=lambda k: (spare[k], k))
            repeats = max(1, min(repeats, left[length] // (pattern.get(length, 0) + 1)))
            cut(length, repeats, gap)
            pattern[gap] = pattern.get(gap, 0) + 1
            repeats = min(repeats, min(left[k] // v for k, v in pattern.items()))
        put(pattern, repeats)
    # Less than one window is left: sequences at powers of two need no padding.
    while left:
        target = 1 << remaining().bit_length() - 1
        pattern = best_fill(left, target)
        gap = target - sum(k * v for k, v in pattern.items())
        if gap:
            length = max(k for k, v in left.items() if k > gap and v > pattern.get(k, 0))
            cut(length, 1, gap)
            pattern[gap] = pattern.get(gap, 0) + 1
        put(pattern, 1)
    return rules, sequence


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def placed(rules: dict[int, list], bases: dict[int, int], capacity: int):
    """A mapInPandas function: rows with their rank by size, and whole windows before them, -> pieces.

    ``bases``: by size, the sequence that the first whole window of such a row gets.
    """

    def run(frames):
        starts = {k: [r[1] for r in v] for k, v in rules.items()}
        for frame in frames:
            out = []
            for doc, tokens, full, rest, rank, before in zip(frame.doc_id, frame.doc_tokens, frame.full, frame.rest, frame["rank"], frame.before, strict=True):
                doc = None if pd.isna(doc) else int(doc)
                for i, crc in enumerate(full):
                    out.append((doc, i * capacity, capacity, int(crc), tokens, bases[len(rest) // 4] + before + i, 0))
                base, todo = len(full) * capacity, [(0, len(rest) // 4, rank)] if rest else []
                while todo:
                    start, length, at = todo.pop()
                    rule = rules[length][int(np.searchsorted(starts[length], at, "right")) - 1]
                    k = at - rule[1]
                    if rule[0] == "put":
                        crc = zlib.crc32(rest[4 * start : 4 * (start + length)])
                        out.append((doc, base + start, length, crc, tokens, rule[4] + k // rule[3], rule[5] + k % rule[3] * length))
                    else:
                        todo.append((start + rule[3], rule[5], rule[6] + k))
                        todo.append((start, rule[3], rule[4] + k))
            columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            made = pd.DataFrame(out, columns=columns)
            yield made.astype({"doc_id": "Int64"} | {c: "int64" for c in columns[1:]})

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    A document's tokens are its ids and one end id. Null and empty texts are the end id
    alone. Rows with equal or null doc_id are documents of their own; other columns are
    ignored. An empty table gives no pieces.
    """
    salts = 64
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = written(spark, slim.mapInArrow(tokenised(tokenizer, capacity, salts), "doc_id long, doc_tokens long, full array<long>, rest binary, salt int"), "packing-ids")
    table = table.withColumns({"size": F.length("rest") / 4, "whole": F.size("full").cast("long")}).withColumn("size", F.col("size").cast("int"))
    # At most `capacity` rows, whatever the input.
    seen = table.groupBy("size").agg(F.count("*").alias("n"), F.sum("whole").alias("w")).collect()
    rules, sequences = plan({r["size"]: r["n"] for r in seen if r["size"]}, capacity)
    bases, at = {}, sequences
    for r in sorted(seen, key=lambda r: r["size"]):
        bases[r["size"]] = at
        at += r["w"]
    most = max([r["n"] for r in seen], default=0)
    wide = sharing(most, least=salts)
    if wide > salts:
        table = table.withColumn("salt", F.col("salt") + F.lit(salts) * F.pmod(F.xxhash64("doc_id", "rest"), F.lit(-(-wide // salts))).cast("int"))
    ranked = numbered(table.withColumn("one", F.lit(1).cast("long")), ["size"], ["doc_id", "doc_tokens", "rest"], "salt", {"rank": "one", "before": "whole"})
    return ranked.select("doc_id", "doc_tokens", "full", "rest", "rank", "before").mapInPandas(placed(rules, bases, capacity), PIECES)
