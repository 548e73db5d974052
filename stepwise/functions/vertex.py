"""The text form of a vertex: ``(distance, [a, b])``, ``[a, b]`` or nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammar. Between numbers stand commas with any signs that are no word
# characters; a distance is a run of digits.
# Possessive loops need no stack, however many neighbours there are.
BARE = r"^\[((?:\d++(?:,\W*+\d++)*+)?)\]\z"
FULL = r"^\((\d++),\W*\[((?:\d++(?:,\W*+\d++)*+)?)\]\)\z"


def numbers(text: Column) -> Column:
    """Comma-separated numbers; blanks around them and empty items are dropped."""
    items = F.filter(F.split(text, ","), lambda x: F.trim(x) != "")
    return F.transform(items, lambda x: F.trim(x).cast("long"))


def parse(text: Column) -> Column:
    """A struct of distance (null if undefined) and adjacencies; other texts raise an error."""
    empty = F.array().cast("array<bigint>")
    shape = lambda d, a: F.struct(d.cast("long").alias("distance"), a.alias("adjacencies"))
    return (
        F.when(text == "", shape(F.lit(None), empty))
        .when(text.rlike(FULL), shape(F.regexp_extract(text, FULL, 1), numbers(F.regexp_extract(text, FULL, 2))))
        .when(text.rlike(BARE), shape(F.lit(None), numbers(F.regexp_extract(text, BARE, 1))))
        .otherwise(F.raise_error(F.concat(F.lit("not a vertex: "), F.coalesce(text, F.lit("null")))).cast("struct<distance:bigint,adjacencies:array<bigint>>"))
    )


def render(distance: Column, adjacencies: Column) -> Column:
    """The inverse of ``parse``; a vertex without distance and neighbours is the empty text."""
    listed = F.concat(F.lit("["), F.array_join(F.transform(adjacencies, lambda x: x.cast("string")), ","), F.lit("]"))
    return F.when(distance.isNotNull(), F.concat(F.lit("("), distance.cast("string"), F.lit(", "), listed, F.lit(")"))).when(F.size(adjacencies) > 0, listed).otherwise(F.lit(""))
