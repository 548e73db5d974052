"""Regular-expression matches with their places, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIND = "array<struct<s:int,e:int,v:string>>"
BLOCK = 256


def matches(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping matches: array of (s, e, v), code points, end exclusive.

    The text is split at the matches; running sums of the lengths are the places. They are
    taken block by block, so that the cost stays linear in the number of matches. Matches
    of ``pattern`` are never empty.
    """
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def placed(z: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            begin = a["p"] + F.char_length(z["p"][i])
            end = begin + F.char_length(z["m"][i])
            return F.struct(end.alias("p"), F.concat(a["o"], F.array(F.struct(begin.alias("s"), end.alias("e"), z["m"][i].alias("v")))).alias("o"))

        def block(a: Column, b: Column) -> Column:
            inner = F.aggregate(F.sequence(b, F.least(b + F.lit(BLOCK - 1), F.size(z["m"]) - 1)), F.struct(a["p"].alias("p"), F.array().cast(KIND).alias("o")), step)
            return F.transform(F.array(inner), lambda q: F.struct(q["p"].alias("p"), F.concat(a["o"], F.array(q["o"])).alias("o")))[0]

        start = F.struct(F.lit(0).alias("p"), F.array().cast(f"array<{KIND}>").alias("o"))
        return F.aggregate(F.sequence(F.lit(0), F.size(z["m"]) - 1, F.lit(BLOCK)), start, block, lambda a: F.flatten(a["o"]))

    return F.when(text.rlike(pattern), F.transform(F.array(parts), placed)[0]).otherwise(F.array().cast(KIND))


def labelled(spans: Column, kind: str, order: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def replaced(text: Column, spans: Column, blank: bool = False) -> Column:
    """The text with every labelled span replaced by ``<KIND>``; overlapping spans by the first's.

    With ``blank`` a line feed stands for a span.
    """

    def step(a: Column, x: Column) -> Column:
        # What an earlier span has covered is gone already.
        fresh = x["s"] >= a["p"]
        tag = F.lit("\n") if blank else F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        added = F.concat(F.expr("''"), text.substr(a["p"] + 1, x["s"] - a["p"]), tag)
        return F.struct(F.greatest(a["p"], x["e"]).alias("p"), F.concat(a["o"], F.when(fresh, added).otherwise(F.lit(""))).alias("o"))

    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("p"), F.lit("").alias("o")), step, lambda a: F.concat(a["o"], text.substr(a["p"] + 1, F.char_length(text))))
