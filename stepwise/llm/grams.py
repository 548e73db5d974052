"""Presence of byte n-grams of whole texts, in numpy: shared by the text classifiers."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def keys(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of ``size`` (up to 8) bytes, and the row of each; none spans two rows."""
    n = len(data)
    if n < size:
        return np.empty(0, np.uint32), np.empty(0, np.int32)
    rows = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    code = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        code <<= np.uint64(8)
        code |= data[k : n - size + 1 + k]
    code += np.uint64(size << 56) if size < 8 else np.uint64(0)
    code *= ODD
    whole = rows[: n - size + 1] == rows[size - 1 :]
    return (code >> np.uint64(64 - BITS)).astype(np.uint32)[whole], rows[: n - size + 1][whole]


def words(data: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes with ``inside[byte]`` within a row: first byte, end, row."""
    mask = inside[data]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    at = starts[:-1][starts[:-1] < len(data)]
    first[at] = mask[at]
    last = mask.copy()
    last[:-1] &= ~mask[1:] | first[1:]
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1, (np.searchsorted(starts, begin, "right") - 1).astype(np.int32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Longer words are hashed one by one; words of so many bytes are hashed together.
LONG_WORD, HASHED = 1 << 12, 1 << 20


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in random numbers of its bytes.

    Words are taken in blocks, so that memory doesn't grow with the text.
    """
    table = np.random.default_rng(64).integers(1, 1 << 63, 256, dtype=np.uint64)
    power = np.full(LONG_WORD, ODD | np.uint64(1))
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    size = end - begin
    long = size > LONG_WORD
    size = np.where(long, 1, size)
    offset = np.cumsum(size) - size
    out = np.empty(len(begin), np.uint64)
    lo = 0
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(offset, offset[lo] + HASHED)))
        first, part = offset[lo:hi] - offset[lo], size[lo:hi]
        place = np.arange(int(part.sum())) - np.repeat(first, part)
        value = table[data[place + np.repeat(begin[lo:hi], part)]] * power[place]
        out[lo:hi] = mixed(np.add.reduceat(value, first))
        lo = hi
    for k in np.flatnonzero(long).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[begin[k] : end[k]].tobytes())
    return out


#: Bytes of words for the classifiers: digits, lower-case letters and all beyond ASCII.
LETTER = np.array([48 <= b < 58 or 97 <= b < 123 or b >= 128 for b in range(256)])


def features(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of ``size`` bytes or, for size 0, hashed words; and the row of each."""
    if size:
        return keys(data, starts, size)
    begin, end, row = words(data, starts, LETTER)
    return (word_hashes(data, begin, end) >> np.uint64(64 - BITS)).astype(np.uint32), row


def presence(data: np.ndarray, starts: np.ndarray, sizes: tuple[int, ...], columns: np.ndarray, width: int) -> np.ndarray:
    """A 0/1 matrix: which of the chosen n-grams each row holds.

    ``columns`` maps a hashed n-gram to its column, or to -1.
    """
    out = np.zeros((len(starts) - 1) * width, np.float32)
    for size in sizes:
        key, row = features(data, starts, size)
        column = columns[key]
        known = column >= 0
        out[row[known].astype(np.int64) * width + column[known]] = 1
    return out.reshape(-1, width)


def frequencies(texts: list[str], sizes: tuple[int, ...]) -> np.ndarray:
    """In how many of the texts each hashed n-gram occurs."""
    out = np.zeros(1 << BITS, np.int32)
    seen = np.zeros(1 << BITS, bool)
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        for size in sizes:
            seen[features(data, np.array([0, len(data)]), size)[0]] = True
        found = np.flatnonzero(seen)
        out[found] += 1
        seen[found] = False
    return out


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def matrix(texts: list[str], sizes: tuple[int, ...], columns: np.ndarray, width: int) -> np.ndarray:
    parts = [presence(*joined(texts[i : i + 256]), sizes, columns, width) for i in range(0, len(texts), 256)]
    return np.concatenate(parts) if parts else np.zeros((0, width), np.float32)


def numbering(chosen: np.ndarray) -> np.ndarray:
    out = np.full(1 << BITS, -1, np.int16)
    out[chosen] = np.arange(len(chosen), dtype=np.int16)
    return out


def lowered(text: str | Column = "text") -> Column:
    """Lower case with every run of white space as one blank, and a blank at either end."""
    text = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"\s+", " "), F.lit(" "))


def draw(doc_id: str | Column = "doc_id", seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the id alone: a reproducible sample."""
    return F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 30)) / F.lit(float(1 << 30))


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus
