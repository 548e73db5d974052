"""Language identification with a blended-spectrum string kernel.

k(x, z) is the cosine of two texts' sets of byte n-grams (2 to 4 bytes, presence only,
limited to the n-grams that most sample texts of a language hold, for each language in turn). Nyström landmarks turn the kernel
into a feature space in which one-versus-rest ridge regression is solved exactly; a block
of texts is scored by two matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks
from .grams import BITS, draw, frequencies, lowered, matrix, numbering, presence, remainder

SIZES = (2, 3, 4)
#: N-grams and landmarks, and the least of them for each language.
WIDTH, WIDTH_EACH = 4096, 128
LANDMARKS, LANDMARKS_EACH = 160, 4
RIDGE = 1e-2
#: The documented bound of the training sample: expected texts of each language, and of all
#: languages together unless that leaves one fewer than ``LEAST``; expected characters of all
#: together, and the longest text that may enter the sample. A language that this leaves
#: without a text enters with its shortest one, whole.
PER_LANGUAGE, ALL, LEAST, CHARACTERS, LONGEST = 400, 80_000, 8, 1 << 26, 20_000
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    columns: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def scores(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        seen = presence(data, starts, SIZES, self.columns, self.landmarks.shape[0])
        return (unit(seen) @ self.landmarks) @ self.weights + self.offset


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 at length one; a row of zeros stays."""
    return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))


def chosen_grams(texts: list[str], label: np.ndarray, languages: int) -> np.ndarray:
    """N-grams by their rank within a language, of equal ranks that of the larger share of texts first."""
    best = np.full(1 << BITS, 1 << BITS, np.int32)
    most = np.zeros(1 << BITS, np.float32)
    for k in range(languages):
        own = [texts[i] for i in np.flatnonzero(label == k)]
        seen = frequencies(own, SIZES)
        order = np.argsort(-seen, kind="stable")[: np.count_nonzero(seen)]
        best[order] = np.minimum(best[order], np.arange(len(order), dtype=np.int32))
        most[order] = np.maximum(most[order], seen[order] / np.float32(len(own)))
    order = np.lexsort((-most, best))[: max(WIDTH, WIDTH_EACH * languages)]
    return order[most[order] > 0]


def fit(texts: list[str], languages: list[str]) -> Model | None:
    """Kernel ridge regression on lowered ``texts``; None without texts."""
    if not texts:
        return None
    names = sorted(set(languages))
    index = {x: k for k, x in enumerate(names)}
    label = np.array([index[x] for x in languages])
    chosen = chosen_grams(texts, label, len(names))
    width = max(1, len(chosen))
    columns = numbering(chosen)
    # Landmarks take turns by language, so that a rare one has as many as a common one.
    turn = np.zeros(len(label), int)
    for k in range(len(names)):
        turn[label == k] = np.arange((label == k).sum())
    leading = np.lexsort((label, turn))[: max(LANDMARKS, LANDMARKS_EACH * len(names))]
    marks = unit(matrix([texts[i] for i in leading], SIZES, columns, width)).T
    value, vector = np.linalg.eigh((marks.T @ marks).astype(float))
    value = np.maximum(value, 1e-6)
    root = vector / np.sqrt(value)
    weight = (1 / np.bincount(label, minlength=len(names)))[label][:, None] * len(label) / len(names)
    # The normal equations are summed up block by block: rows of n-grams are wide.
    left, right = RIDGE * np.eye(len(leading) + 1), np.zeros((len(leading) + 1, len(names)))
    for i in range(0, len(texts), 1024):
        at = slice(i, i + 1024)
        rows = unit(matrix(texts[at], SIZES, columns, width))
        features = np.hstack([rows @ marks @ root, np.ones((len(rows), 1))])
        left += features.T @ (weight[at] * features)
        right += features.T @ (weight[at] * np.where(label[at][:, None] == np.arange(len(names)), 1.0, -1.0))
    solved = np.linalg.solve(left, right)
    return Model(names, columns, marks.astype(np.float32), (root @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32))


def sample(docs: DataFrame) -> tuple[list[str], list[str]]:
    """A bounded, reproducible sample of the labelled rows of ``docs`` (doc_id, text, lang).

    Every language that is a label is in it. Rows that repeat count once.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    short = F.length("text") <= LONGEST
    # One row for each label.
    counts = known.groupBy("lang").agg(F.count(F.when(short, 1)).alias("n"), F.coalesce(F.sum(F.when(short, F.length("text"))), F.lit(0)).alias("size")).collect()
    if not counts:
        return [], []
    each = min(PER_LANGUAGE, max(LEAST, ALL // len(counts)))
    part = lambda r: min(1.0, each / max(1, r["n"]), CHARACTERS / len(counts) / max(1, r["size"]))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], part(r))])
    # A language with few texts has all its rows drawn; one with many, by chance, enough of them.
    drawn = known.filter(short & (draw() < share[F.col("lang")]))
    rows = drawn.select("doc_id", lowered().alias("text"), "lang").distinct().collect()
    missing = sorted({r["lang"] for r in counts} - {r["lang"] for r in rows})
    if missing:
        least = F.min_by(F.struct("doc_id", "text"), F.struct(F.length("text"), "doc_id", "text"))
        rest = known.filter(F.col("lang").isin(missing)).groupBy("lang").agg(least.alias("one"))
        rows += rest.select("one.doc_id", lowered(F.col("one.text")).alias("text"), "lang").collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["lang"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def predicted(model: Model | None):
    """A mapInArrow function: (doc_id, held_out, has a letter, text) -> prediction."""

    def run(batches):
        for batch in batches:
            letters = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            for lo, hi, data, starts in text_blocks(batch.column(3), rows=512):
                names, values = [UNKNOWN] * (hi - lo), [0.0] * (hi - lo)
                if model:
                    found = model.scores(data, starts)
                    best = found.argmax(1)
                    sure = np.clip((found[np.arange(hi - lo), best] + 1) / 2, 0, 1)
                    for i in np.flatnonzero(letters[lo:hi]).tolist():
                        names[i], values[i] = model.languages[best[i]], float(sure[i])
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(lo, hi - lo) for k in (0, 1)], pa.array(names, pa.string()), pa.array(values, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """Predict the language of every text of ``docs`` (doc_id, text, lang).

    Learns from text and lang of rows whose crc32(doc_id) mod ``modulus`` is not
    ``held_out``; the prediction sees the text alone. Null texts and texts without a
    letter are ``und`` with score 0, as is every text if there is nothing to learn from.
    Equal texts get equal results; other columns are ignored; no rows give no rows.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(*sample(slim.filter(remainder("doc_id", modulus) != held_out)))
    asked = slim.select("doc_id", (remainder("doc_id", modulus) == held_out).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), lowered().alias("text"))
    return asked.mapInArrow(predicted(model), "doc_id long, held_out boolean, lang_pred string, score double")
