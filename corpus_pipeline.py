"""A corpus pipeline: five stages from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what
it returns is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepwise.llm.common import temporaries
from stepwise.llm.exact_dedup import without_copies
from stepwise.llm.mixing import mixed_documents
from stepwise.llm.ngram_join import without_near_copies
from stepwise.llm.packing import pack
from stepwise.llm.queries import tokenizer_path
from stepwise.llm.toxicity import THRESHOLD, toxicity, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold.

    Null and empty texts have the score of no evidence and stay. Rows that repeat, and rows
    with equal or null ids, are judged each by its text alone, equal texts alike. No rows
    give no rows. Columns are returned as they are.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity(model) < THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id.

    Null texts equal empty ones; null ids are the smallest; of rows that repeat both id and
    text one stays, whichever. No rows give no rows. Columns are returned as they are.
    """
    return without_copies(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the one with the smallest doc_id.

    Texts without words (null, empty, blank) are nobody's copies and stay, one of each id
    and text; null ids are the largest. No rows give no rows. Columns are returned as they are.
    """
    return without_near_copies(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order in which it serves them.

    Texts without words (null, empty, blank) are never served; a null source is a source
    of its own; rows that repeat are documents of their own. No rows give no rows. Columns
    are returned as they are. Tables have no order, and packing goes by length, so what is
    left of the order of service further on is each source's share.
    """
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences.

    Null and empty texts are the end id alone; every row is a document of its own, whatever
    its id; other columns are ignored. No rows give no pieces.
    """
    return pack(spark, docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier is not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``.

    What a stage read and wrote on its way is deleted once its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with temporaries(spark) as keep_last:
        for name, stage in STAGES[:-1]:
            with temporaries(spark) as keep:
                docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        return keep_last(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}")
