"""Personal data, and the terms that give it away.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Information theory
finds what else reveals them. A term is any run of letters and digits outside these
entities. Over all documents, how much a term t tells of the presence of an entity kind c
(one of the four, or any of them) is their pointwise mutual information, and set against
the kind's own information content log2(1 / p(c)) it is the share of the secret that t
discloses. Terms above a threshold, next to enough different entities (all those of a
document count), are sensitive in documents that hold such an entity. So are terms that
disclose as much of a single entity's information, next to it in two documents or more,
where that entity is. They are generalised to a tag or removed there with the entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import with_groups, written
from .spans import labelled, listed, matches, replaced

#: Share of an entity kind's information that a term may disclose, and the least number of
#: different entities next to which it must stand.
DISCLOSED, SUPPORT = 0.75, 8
#: The least number of documents that hold a term together with one entity that it discloses.
TOGETHER = 2
LOCAL = "A-Za-z0-9._%+-"
#: A match starts at the head of a run of such signs or where the last match has ended,
#: which keeps the search linear; possessive loops need no stack.
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Only whole runs of 12 to 19 digits; shorter and longer ones would be dropped.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
KINDS = ("email", "ip", "card", "phone")
#: The presence of an entity of whichever kind.
ANY = "any"
#: Stands for a kind as a whole among the hashes of its values.
WHOLE = 0
#: Letters with their marks, and digits.
TERM = r"[\p{L}\p{M}\p{N}]++"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def entities(text: Column) -> dict[str, Column]:
    count = lambda x: F.length(digits(x["v"]))
    return {
        "email": F.when(F.contains(text, F.lit("@")), matches(text, EMAIL)).otherwise(matches(F.lit(""), EMAIL)),
        "ip": F.filter(matches(text, IP), lambda x: x["v"].rlike(BYTE)),
        "card": F.filter(matches(text, CARD), lambda x: F.call_function("luhn_check", digits(x["v"]))),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(matches(text, PHONE), lambda x: (count(x) >= 9) & (count(x) <= 15))).otherwise(matches(F.lit(""), PHONE)),
    }


def terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda x: x != ""))


def plain(frame: DataFrame) -> Column:
    """The entities of all kinds as labelled spans."""
    return F.concat(*[labelled(F.col(k), k, i) for i, k in enumerate(KINDS)])


def disclosing(spark: SparkSession, docs: DataFrame, near: DataFrame, held: dict[str, int], disclosed: float = DISCLOSED, support: int = SUPPORT) -> DataFrame:
    """Terms that disclose a kind or one entity, from all of ``docs``: (term, kind, value, joint, disclosure, sensitive).

    ``near`` is what ``neighbours`` returns, ``held`` the number of documents with each
    kind. The value is ``WHOLE`` for a kind; ``joint`` counts the documents with both.
    Frequent pairs, fewer than a thousand, are listed even where they aren't sensitive.
    """
    total = docs.count()
    met = near.select(F.explode("terms").alias("term"), "asked").select("term", F.explode("asked").alias("x")).select("term", "x.*")
    # A value of one document alone is a different one wherever it stands; only shared ones are told apart.
    met = written(spark, met.groupBy("term", "kind", "value").agg(F.count("*").alias("joint"), F.sum("single").alias("single"), F.first("held").alias("held")), "pii-met")
    pairs = met.agg(F.coalesce(F.sum("joint"), F.lit(0))).first()[0]
    whole = F.create_map(*[F.lit(x) for k, n in held.items() for x in (k, n)])[F.col("kind")].cast("long")
    joint = met.groupBy("term", "kind").agg(F.sum(F.when(F.col("value") == WHOLE, F.col("joint"))).alias("joint"), (F.sum("single") + F.count(F.when(F.col("value") != WHOLE, 1))).alias("support"))
    often = F.col("joint") * 1000 > pairs
    joint = joint.filter((F.col("support") >= support) | often).select("term", "kind", F.lit(WHOLE).cast("long").alias("value"), "joint", whole.alias("held"), (F.col("support") >= support).alias("enough"))
    single = met.filter((F.col("value") != WHOLE) & (F.col("joint") >= TOGETHER)).select("term", "kind", "value", "joint", "held", F.lit(True).alias("enough"))
    everywhere = docs.select(F.explode(terms(F.coalesce(F.col("text"), F.lit("")))).alias("term"), F.lit(1).alias("n"))
    # Terms that a document holds inside entities alone are none of its terms.
    everywhere = everywhere.unionByName(near.select(F.explode("hidden").alias("term"), F.lit(-1).alias("n"))).groupBy("term").agg(F.sum("n").alias("alone"))
    information = F.log2(F.lit(total) / F.col("held"))
    mutual = F.log2(F.col("joint") * F.lit(float(total)) / (F.col("alone") * F.col("held")))
    scored = joint.unionByName(single).join(everywhere, "term").withColumn("disclosure", F.when(information > 0, mutual / information).otherwise(F.lit(0.0)))
    scored = scored.withColumn("sensitive", F.col("enough") & (F.col("disclosure") >= disclosed))
    return written(spark, scored.filter(F.col("sensitive") | often).select("term", "kind", "value", "joint", "disclosure", "sensitive"), "pii-flagged")


def neighbours(spark: SparkSession, found: DataFrame) -> DataFrame:
    """Terms and entities of each document of ``found`` (row, text, an array for each kind).

    Returns row, terms (outside entities), hidden (those only inside) and asked: for each
    kind there, and for ``ANY``, an entry of value ``WHOLE`` with the number of its
    different values that no other document holds, and an entry for each of its values that
    others hold as well, with the number of documents that hold it.
    """
    hashed = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), F.xxhash64(x["v"]).alias("value"))
    kinds = F.flatten(F.array(*[F.array_distinct(F.transform(k, hashed(k))) for k in KINDS]))
    there = written(spark, found.select("row", F.explode(kinds).alias("x")).select("row", "x.*"), "pii-values")
    counts = there.groupBy("kind", "value").agg(F.count("*").alias("held")).filter("held > 1")
    shared = F.col("held").isNotNull()
    known = with_groups(there, counts, ["kind", "value"], "held").unionByName(there.join(counts, ["kind", "value"], "left_anti").withColumn("held", F.lit(None).cast("long")))
    by = known.groupBy("row", "kind").agg(F.count(F.when(~shared, 1)).alias("single"), F.collect_list(F.when(shared, F.struct("value", "held"))).alias("shared"))
    entry = lambda kind, value, single, held: F.struct(kind.alias("kind"), value.alias("value"), single.alias("single"), held.alias("held"))
    none, of, kind = F.lit(0).cast("long"), F.lit(WHOLE).cast("long"), F.col("kind")
    asked = F.concat(F.array(entry(kind, of, F.col("single"), none)), F.transform("shared", lambda v: entry(kind, v["value"], none, v["held"])))
    asked = by.groupBy("row").agg(F.flatten(F.collect_list(asked)).alias("asked"), F.sum("single").alias("single"))
    asked = asked.select("row", F.concat("asked", F.array(entry(F.lit(ANY), of, F.col("single"), none))).alias("asked"))
    outside = found.select("row", terms(F.col("text")).alias("every"), terms(replaced(F.col("text"), plain(found), blank=True)).alias("terms"))
    return written(spark, outside.select("row", "terms", F.array_except("every", "terms").alias("hidden")).join(asked, "row"), "pii-near")


def find(spark: SparkSession, docs: DataFrame, disclosed: float = DISCLOSED, support: int = SUPPORT, sanitised: bool = False) -> DataFrame:
    """Personal data in every whole text of ``docs`` (doc_id, text).

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; n_term counts the
    spans that the disclosure of terms adds. With ``sanitised`` also the text with each
    span as a tag. Null texts count as empty. Rows with equal ids are documents of their
    own; other columns are ignored; no rows give no rows.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    base = slim.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text")).withColumns(entities(F.col("text")))
    some = F.size("email") + F.size("ip") + F.size("card") + F.size("phone") > 0
    base = written(spark, base.withColumn("text", F.when(some | F.lit(sanitised), F.col("text"))), "pii")
    found = base.filter(some)
    held = {k: n for k, n in base.agg(F.count(F.when(some, 1)).alias(ANY), *[F.count(F.when(F.size(k) > 0, 1)).alias(k) for k in KINDS]).first().asDict().items() if n}
    out = base.withColumn("term", F.array().cast("array<struct<s:int,e:int,v:string>>"))
    if held:
        near = neighbours(spark, found)
        told = near.select("row", "terms", F.explode("asked").alias("x")).select("row", "x.kind", "x.value", F.explode("terms").alias("term"))
        told = with_groups(told, disclosing(spark, slim, near, held, disclosed, support), ["term", "kind", "value"], "joint").filter("sensitive")
        told = told.groupBy("row").agg(F.collect_set("term").alias("telling"))
        added = found.join(told, "row").select("row", F.filter(matches(F.col("text"), TERM), lambda x: F.array_contains("telling", F.lower(x["v"]))).alias("added"))
        out = out.join(added, "row", "left").withColumn("term", F.coalesce("added", "term"))
    out = out.withColumn("plain", plain(out))
    inside = lambda x: F.exists("plain", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
    out = out.withColumn("all", F.concat("plain", labelled(F.filter("term", lambda x: ~inside(x)), "term", len(KINDS))))
    columns = ["doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(listed(F.col("plain")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"), (F.size("all") - F.size("plain")).cast("long").alias("n_term")]
    return out.select(*columns, *([replaced(F.col("text"), F.col("all")).alias("sanitised")] if sanitised else []))
