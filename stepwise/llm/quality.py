"""Quality rules under weak supervision.

Every rule looks at one measure of a text and votes good, votes bad or abstains. Rules that
measure one thing in several ways form a family. Which rules are right how often is not
given: expectation-maximisation estimates from the votes of all documents how texts
divide into good ones, texts that fail in one family and texts that fail in all, and how
each rule votes on those that fail in its family and on all others. Where rules of a family
disagree, the more accurate ones prevail; a rule that has nothing to agree with keeps the
accuracy it is given. Accuracies stay above one half, so a bad vote never speaks for a
text. A text's verdict is the posterior probability of being good. All that the estimation
needs of the corpus is how often each pattern of votes occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_blocks, written
from .grams import mixed, word_hashes, words

#: Bytes of words: all but blank, tab, line feed, vertical tab, form feed, carriage return.
INSIDE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
SYMBOLS = np.array([chr(b) in "#*$%&|<>" for b in range(256)])

#: Rule: measure, good up to, bad from; between the two it abstains.
RULES = {
    "short": ("n_words", 80, 40, "few"),
    "word_length": ("mean_word", 9.0, 14.0, "many"),
    "symbols": ("symbol_rate", 0.05, 0.3, "many"),
    "lines": ("line_rate", 0.1, 0.3, "many"),
    "repeats": ("repeat_rate", 0.2, 0.4, "many"),
    "distinct": ("distinct_rate", 0.3, 0.15, "few"),
}
#: Rules of a family measure one thing.
FAMILIES = (("short",), ("word_length",), ("symbols",), ("lines", "repeats", "distinct"))
VERDICT = 0.5
#: At the start: the share of good texts, how often a rule is right on a text that fails in
#: its family, how often one bad vote alone is right, how often a rule abstains; and the
#: number of texts that this counts as in the estimation.
PRIOR, RIGHT, PRECISION, ABSTAINS, STRENGTH = 0.8, 0.8, 0.8, 0.1, 10.0
ROUNDS = 2000


def measured(batches):
    """A mapInArrow function: (doc_id, text) -> the measures of each whole text."""
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct"]
    for batch in batches:
        for lo, hi, data, starts in text_blocks(batch.column(1), rows=1024):
            n = hi - lo
            out = {c: np.zeros(n, np.int64) for c in columns}
            begin, end, row = words(data, starts, INSIDE)
            out["n_words"] = np.bincount(row, minlength=n)
            out["word_chars"] = counted(((data & 0xC0) != 0x80) & INSIDE[data], starts)
            out["n_symbols"] = counted(SYMBOLS[data], starts)
            if len(begin):
                code = word_hashes(data, begin, end)
                salted = mixed(row.astype(np.uint64) + np.uint64(1))
                out["n_distinct"] = per_row(np.unique(code ^ salted, return_index=True)[1], row, n)
                out["n_repeat_words"] = repeated(code, salted, row, n)
                lines(data, starts, begin, end, row, code, salted, out)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), *[pa.array(out[c], pa.int64()) for c in columns]], ["doc_id", *columns])


def counted(marks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many bytes of each row are marked."""
    out = np.zeros(len(starts) - 1, np.int64)
    there = np.flatnonzero(np.diff(starts))
    if len(there):
        out[there] = np.add.reduceat(marks, starts[there], dtype=np.int64)
    return out


def per_row(places: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row[places], minlength=n)


def repeated(code: np.ndarray, salted: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Words of each row that stand in a window of three words found twice in the row."""
    if len(code) < 3:
        return np.zeros(n, np.int64)
    window = mixed(code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:]
    window = mixed(window) ^ salted[:-2]
    whole = np.flatnonzero(row[:-2] == row[2:])
    _, back, count = np.unique(window[whole], return_inverse=True, return_counts=True)
    twice = whole[count[back] > 1]
    covered = np.zeros(len(code), bool)
    for k in range(3):
        covered[twice + k] = True
    return np.bincount(row[covered], minlength=n)


def lines(data, starts, begin, end, row, code, salted, out) -> None:
    """Lines with a word, and those equal to an earlier line of the row.

    A line is what stands between line feeds, white space included.
    """
    feed = np.flatnonzero(data == 10)
    head = np.unique(np.concatenate([starts[:-1][starts[:-1] < len(data)], feed + 1]))
    head = head[head < len(data)]
    tail = np.append(head[1:], len(data))
    tail = tail - (data[tail - 1] == 10)
    full = tail > head
    head, tail = head[full], tail[full]
    with_word = np.searchsorted(begin, tail) > np.searchsorted(begin, head)
    head, tail = head[with_word], tail[with_word]
    of = np.searchsorted(starts, head, "right") - 1
    key = word_hashes(data, head, tail) ^ mixed(of.astype(np.uint64) + np.uint64(1))
    first = np.unique(key, return_index=True)[1]
    n = len(out["n_words"])
    out["n_lines"] = np.bincount(of, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(of[first], minlength=n)


def votes(frame: DataFrame) -> DataFrame:
    """Adds ``pattern``: of each rule g (good), b (bad) or - (abstains)."""
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    measures = {
        "n_words": F.col("n_words"),
        "mean_word": rate("word_chars", "n_words"),
        "symbol_rate": rate("n_symbols", "n_words"),
        "line_rate": rate("n_dup_lines", "n_lines"),
        "repeat_rate": rate("n_repeat_words", "n_words"),
        # Longer texts repeat more words: Heaps' law with exponent one half.
        "distinct_rate": F.when(F.col("n_words") > 0, F.col("n_distinct") / F.sqrt("n_words") / 10).otherwise(F.lit(0.0)),
    }
    signs = []
    for measure, good, bad, kind in RULES.values():
        x = measures[measure]
        is_good, is_bad = (x <= good, x >= bad) if kind == "many" else (x >= good, x <= bad)
        signs.append(F.when(is_good, "g").when(is_bad, "b").otherwise("-"))
    return frame.withColumn("pattern", F.concat(*signs))


def held(rates: np.ndarray, right: int) -> np.ndarray:
    """Rates of good and bad votes (columns 0 and 1) with at least half of the votes ``right``."""
    voting = rates[:, 0] + rates[:, 1]
    out = rates.copy()
    out[:, right] = np.maximum(out[:, right], voting / 2)
    out[:, 1 - right] = voting - out[:, right]
    return out


def posterior(counts: dict[str, int], families: tuple[tuple[int, ...], ...] = ()) -> dict[str, float]:
    """Probability of good by vote pattern, after expectation-maximisation over all counts.

    ``families`` lists the places of each family's rules in a pattern; without families all
    rules watch for the same failure. Classes are good texts (0), texts that fail in one
    family (1 to their number) and texts that fail in all (last). A rule has two sets of
    rates for its three votes: one on texts that fail in its family and one on all others.
    """
    if not counts:
        return {}
    patterns = sorted(counts)
    weight = np.array([counts[p] for p in patterns], float)
    cast = np.array([[[x == v for v in "gb-"] for x in p] for p in patterns], float)
    rules, kinds = cast.shape[1], len(families) + 2
    fails = np.zeros((kinds, rules), bool)
    for k, family in enumerate(families):
        fails[k + 1, list(family)] = True
    fails[-1] = True
    shares = np.array([PRIOR, *[(1 - PRIOR) / (kinds - 1)] * (kinds - 1)])
    false = shares[1] / shares[0] * RIGHT * (1 - PRECISION) / PRECISION
    votes = 1 - ABSTAINS
    bad = np.tile([(1 - RIGHT) * votes, RIGHT * votes, ABSTAINS], (rules, 1))
    fine = np.tile([(1 - false) * votes, false * votes, ABSTAINS], (rules, 1))
    first = shares, bad, fine
    for _ in range(ROUNDS):
        each = [np.einsum("prv,rv->pr", cast, np.log(x)) for x in (fine, bad)]
        log = np.log(shares) + each[0] @ ~fails.T + each[1] @ fails.T
        part = np.exp(log - log.max(1, keepdims=True))
        part /= part.sum(1, keepdims=True)
        mass = part * weight[:, None]
        new = [np.einsum("pk,kr,prv->rv", mass, on.astype(float), cast) + STRENGTH * start for on, start in ((fails, first[1]), (~fails, first[2]))]
        moved = bad
        bad, fine = (held(x / x.sum(1, keepdims=True), right) for x, right in zip(new, (1, 0), strict=True))
        shares = (mass.sum(0) + STRENGTH * first[0]) / (weight.sum() + STRENGTH)
        if np.abs(bad - moved).max() < 1e-9:
            break
    return dict(zip(patterns, part[:, 0].tolist(), strict=True))


def judged(spark: SparkSession, docs: DataFrame, verdict: float = VERDICT) -> DataFrame:
    """Measure and judge every whole text of ``docs`` (doc_id, text).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, p_good and pattern. Null texts count as empty; texts without words
    fail. Equal texts get equal rows. Other columns are ignored; no rows give no rows.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"{c} long" for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct"))
    table = written(spark, votes(slim.mapInArrow(measured, kinds)), "quality")
    # At most 3 ** len(RULES) patterns exist.
    counts = {r["pattern"]: r["count"] for r in table.groupBy("pattern").count().collect()}
    places = {rule: k for k, rule in enumerate(RULES)}
    rows = sorted(posterior(counts, tuple(tuple(places[x] for x in family) for family in FAMILIES)).items())
    known = spark.createDataFrame(rows, "pattern string, p_good double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = table.join(F.broadcast(known), "pattern", "left").withColumn("base_failed", failed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("p_good") >= verdict)).alias("kept"), "p_good", "pattern")
