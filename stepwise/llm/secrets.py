"""Secrets: known forms, and strings that pass a battery of randomness tests.

A candidate is a run of 16 or more signs of an encoding. Its encoding is inferred from
its signs, and three tests ask whether it looks drawn at random from that alphabet:
chi-squared for uniform use of the alphabet, runs above and below its middle, and serial
correlation of neighbours. Their sum of squares is small for keys and large for ordinary
strings. A candidate that the battery itself rejects as random is none. How small the sum
gets for ordinary strings is read off the corpus: all its long plain words that recur, taken as strings of
the candidate's own encoding, by length class, since short strings look random more easily. From those
p-values the Benjamini-Hochberg procedure, with Storey's estimate of the share of ordinary
strings in each encoding and length class, flags candidates at a false discovery rate.

Runs of digits alone are not asked: nothing in a corpus tells an ordinary long number from
a random one (card numbers are found by ``pii``). Runs of letters alone are asked unless
they recur, since recurring ones are what ordinary strings are told by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import with_groups, written
from .spans import labelled, listed, matches, replaced

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGNED = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex")
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"
#: Encoding: its form, and its alphabet in order; case is dropped where only one is used.
#: Tried in this order.
ENCODINGS = {
    "decimal": (r"^[0-9]+$", "0123456789"),
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    "base26": (r"^(?:[a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz"),
    "base36": (r"^(?:[0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "base52": (r"^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "base62": (r"^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "base64": (r"^[0-9A-Za-z+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}
ONE_CASE = ("hex", "base26", "base36")
#: Length classes start at these lengths.
LENGTHS = (16, 20, 24, 32, 48)
RATE = 0.05
BIN, BINS = 0.25, 400
#: The sum of squares that a random string exceeds once in a thousand: chi-squared with 3
#: degrees of freedom.
REJECTED = 16.27
#: Signs of a string that are looked at together.
PART = 4096


def forms(text: Column) -> dict[str, Column]:
    return {
        "assign": F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["v"], ASSIGNED, 1)) >= 12),
        "access": matches(text, ACCESS),
        "hex": matches(text, HEX),
    }


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def neighbours(value: Column, alphabet: Column) -> Column:
    """The sum over neighbouring signs of the product of their places in the alphabet.

    Signs are numbered part by part, so that no array is longer than ``PART``.
    """
    place = lambda c: F.instr(alphabet, c).cast("double")
    step = lambda a, c: let(place(c), lambda x: F.struct(x.alias("last"), (a["sum"] + a["last"] * x).alias("sum")))
    start = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("sum"))
    parts = F.regexp_extract_all(value, F.lit(f".{{1,{PART}}}+"), F.lit(0))
    return F.aggregate(parts, start, lambda a, part: F.aggregate(F.split(part, ""), a, step), lambda a: a["sum"])


def halves(value: Column, alphabet: Column) -> Column:
    """The string with every sign as a or b, by the half of the alphabet in which it stands."""
    out = F.lit(None).cast("string")
    for _, signs in ENCODINGS.values():
        two = "".join("b" if 2 * (k + 1) > len(signs) else "a" for k in range(len(signs)))
        out = F.when(alphabet == signs, F.translate(value, signs, two)).otherwise(out)
    return out


def battery(value: Column, alphabet: Column) -> Column:
    """The three tests of a string over its alphabet: sum of squared normal scores.

    Each score is about standard normal for a random string; too even a use of the
    alphabet counts as well as too uneven a one. Time is linear in the string's length:
    counts come from replacing a sign, runs from matching over two signs, and products of
    neighbours from one pass.
    """
    n = F.char_length(value).cast("double")
    size = F.char_length(alphabet)
    places = F.sequence(F.lit(1), size)
    counts = F.transform(places, lambda k: n - F.char_length(F.replace(value, F.substring(alphabet, k, F.lit(1)), F.lit(""))))

    def scores(c: Column) -> Column:
        m = size.cast("double")
        total = lambda f: F.aggregate(F.zip_with(places, c, f), F.lit(0.0), lambda a, x: a + x)
        uniform = (total(lambda k, x: x * x) * m / n - n - (m - 1)) / F.sqrt(2 * (m - 1) * (n - 1) / n)
        above = total(lambda k, x: F.when(k * 2 > size, x).otherwise(F.lit(0.0)))
        sums = F.struct(above.alias("above"), (total(lambda k, x: k * x) / n).alias("mean"), total(lambda k, x: k * k * x).alias("squares"))
        return let(sums, lambda z: uniform * uniform + ran(z) + serial(z))

    def ran(z: Column) -> Column:
        marked = halves(value, alphabet)
        expected = 2 * z["above"] * (n - z["above"]) / n + 1
        spread = (expected - 1) * (expected - 2) / (n - 1)
        runs = F.regexp_count(marked, F.lit("a++|b++")).cast("double")
        return F.when(spread > 0, F.pow(runs - expected, F.lit(2.0)) / spread).otherwise(n)

    def serial(z: Column) -> Column:
        # The sum of (x - mean)(y - mean) over neighbours, from sums that are known.
        place = lambda at: F.instr(alphabet, F.substring(value, at, 1)).cast("double")
        together = neighbours(value, alphabet) - z["mean"] * (2 * n * z["mean"] - place(1) - place(-1)) + (n - 1) * z["mean"] * z["mean"]
        variance = z["squares"] - n * z["mean"] * z["mean"]
        return F.when(variance > 1e-9, F.pow(together / variance, F.lit(2.0)) * n).otherwise(n)

    return let(counts, scores)


def encoded(value: Column, encoding: Column) -> Column:
    """The string as its alphabet has it: lower case, or the signs for URLs as the usual ones."""
    return F.when(encoding.isin(*ONE_CASE), F.lower(value)).when(encoding == "base64", F.translate(value, "-_", "+/")).otherwise(value)


def tested(found: DataFrame) -> DataFrame:
    """Adds statistic, level (its length class) and bin to rows (``v``, ``encoding``)."""
    alphabet = F.create_map(*[F.lit(x) for name, (_, signs) in ENCODINGS.items() for x in (name, signs)])[F.col("encoding")]
    frame = found.withColumn("alphabet", alphabet).withColumn("plain", encoded(F.col("v"), F.col("encoding")))
    level = sum((F.length("v") >= k).cast("int") for k in LENGTHS)
    frame = frame.withColumn("statistic", battery(F.col("plain"), F.col("alphabet"))).withColumn("level", level)
    return frame.withColumn("bin", F.least(F.floor(F.col("statistic") / BIN), F.lit(BINS)).cast("int")).drop("alphabet", "plain")


def inferred(value: Column) -> Column:
    encoding = F.lit(None).cast("string")
    for name, (form, _) in reversed(ENCODINGS.items()):
        encoding = F.when(value.rlike(form), name).otherwise(encoding)
    return encoding


def ordinary(values: DataFrame) -> DataFrame:
    """Ordinary strings, once for each encoding that they are a null sample of: (v, encoding).

    ``values`` (v, encoding, n): different candidates and how often each occurs. Ordinary
    are words of letters alone that recur; they are strings of every alphabet with letters,
    of the hexadecimal one if it has all of theirs.
    """
    lower, mixed = ("base26", "base36", "base52", "base62", "base64"), ("base52", "base62", "base64")
    of = F.when(F.col("encoding") == "hex", F.array(*map(F.lit, ("hex", *lower)))).when(F.col("encoding") == "base26", F.array(*map(F.lit, lower))).otherwise(F.array(*map(F.lit, mixed)))
    return values.filter(F.col("v").rlike("^[A-Za-z]+$") & (F.col("n") > 1)).select("v", F.explode(of).alias("encoding"))


def discoveries(asked: DataFrame, null: DataFrame, rate: float) -> DataFrame:
    """Which cells (encoding, level, bin) of ``asked`` are discoveries at a false discovery rate.

    At most encodings times levels times bins cells exist, so these windows are over small
    tables. The p-value of a cell: how many ordinary strings of its encoding, of its length
    class and the shorter ones, have as small a statistic; those classes are pooled since
    long words are rare. Without any there is nothing to mistake a candidate for.
    """
    grid = asked.groupBy("encoding", "level", "bin").agg(F.count("*").alias("asked"))
    words = null.groupBy("encoding", F.col("level").alias("l"), F.col("bin").alias("b")).agg(F.count("*").alias("words"))
    # Both sides have at most levels times bins rows for an encoding.
    near = grid.join(words, (grid["encoding"] == words["encoding"]) & (F.col("l") <= F.col("level")), "left").groupBy(grid["encoding"], "level", "bin", "asked")
    scored = near.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("b") <= F.col("bin"), F.col("words"))), F.lit(0)).alias("as_small"))
    scored = scored.withColumn("p", F.when(F.col("all") == 0, 0.0).otherwise((F.col("as_small") + 1) / (F.col("all") + 1)))
    # Storey's estimate of the share of candidates that are no keys, for each class.
    of = Window.partitionBy("encoding", "level")
    rank = of.orderBy("p").rangeBetween(Window.unboundedPreceding, 0)
    chance = F.least(F.lit(1.0), (1 + F.sum(F.when(F.col("p") > 0.5, F.col("asked")).otherwise(0)).over(of)) / (0.5 * F.sum("asked").over(of)))
    ranked = scored.withColumn("passes", F.col("p") * chance <= rate * F.sum("asked").over(rank) / F.sum("asked").over(of))
    ranked = ranked.withColumn("cut", F.max(F.when(F.col("passes"), F.col("p"))).over(of))
    return ranked.filter((F.col("p") <= F.col("cut")) & (F.col("bin") * BIN <= REJECTED)).select("encoding", "level", "bin")


def scan(spark: SparkSession, docs: DataFrame, rate: float = RATE, redacted: bool = False) -> DataFrame:
    """Secrets in every whole text of ``docs`` (doc_id, text).

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans; n_random counts the
    strings that the battery adds, those inside a span of a known form left out. With
    ``redacted`` also the text with each span as a tag. Null texts count as empty. Rows
    with equal ids are documents of their own; other columns are ignored; no rows give no
    rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    base = base.withColumns(forms(F.col("text")) | {"candidates": matches(F.col("text"), CANDIDATE)})
    base = written(spark, base if redacted else base.drop("text"), "secrets")
    values = base.select(F.explode("candidates.v").alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    values = values.withColumn("encoding", inferred(F.col("v")))
    tried = (F.col("encoding") != "decimal") & ~(F.col("v").rlike("^[A-Za-z]+$") & (F.col("n") > 1))
    sample = values.filter(tried).select("v", "encoding", "n", F.lit(True).alias("asked")).unionByName(ordinary(values).select("v", "encoding", F.lit(0).alias("n"), F.lit(False).alias("asked")))
    table = written(spark, tested(sample), "secrets-tests")
    cells = F.broadcast(discoveries(table.filter("asked"), table.filter("NOT asked"), rate))
    flagged = table.filter("asked").join(cells, ["encoding", "level", "bin"]).select(F.sha2("v", 256).alias("key"), "n")
    places = base.select("row", F.explode("candidates").alias("x")).select("row", "x.*", F.sha2("x.v", 256).alias("key"))
    random = with_groups(places, flagged, "key", "n").groupBy("row").agg(F.collect_list(F.struct("s", "e", "v")).alias("random"))
    out = base.join(random, "row", "left").withColumn("random", F.coalesce("random", F.array().cast("array<struct<s:int,e:int,v:string>>")))
    plain = F.concat(*[labelled(F.col(k), k, i) for i, k in enumerate(KINDS)])
    out = out.withColumn("plain", plain)
    inside = lambda x: F.exists("plain", lambda y: (y["s"] <= x["s"]) & (x["e"] <= y["e"]))
    out = out.withColumn("random", F.filter("random", lambda x: ~inside(x))).withColumn("all", F.concat("plain", labelled(F.col("random"), "random", len(KINDS))))
    columns = ["doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(listed(F.col("plain")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"), F.size("random").cast("long").alias("n_random")]
    return out.select(*columns, *([replaced(F.col("text"), F.col("all")).alias("redacted")] if redacted else []))
