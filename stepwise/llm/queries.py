"""The corpus queries and their SQL; ``__spark_entry__`` adds them to its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shards

    return shards(spark, table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_copies

    return exact_copies(spark, table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find

    return find(spark, table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_copies

    return near_copies(spark, table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(spark, table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judged

    return judged(spark, table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_exact_dedup, op3_language_id, op4_toxicity, op5_pii, op6_ngram_join, op7_secrets, op8_packing, op9_mixing, op10_quality)}

ORACLES = {
    "op1_sharding": """
        WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash FROM documents),
        l AS (SELECT d.*, r.range AS depth, sum(n_bytes) OVER w AS shard_bytes, count(*) OVER w AS shard_docs FROM d, range(0, 16) r WINDOW w AS (PARTITION BY r.range, hash >> (60 - r.range))),
        f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS n FROM l WHERE shard_bytes <= 1048576)
        SELECT doc_id, n_bytes, substr(right(format('{:064b}', hash), 60), 1, depth::INTEGER) AS shard, depth::INTEGER AS depth, shard_bytes::BIGINT AS shard_bytes, shard_docs FROM f WHERE n = 1""",
    "op2_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        n AS (SELECT *, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM n""",
    "op9_mixing": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
            ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size,
            CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS n FROM s),
        p AS (SELECT *, sum(source_size) OVER ()::BIGINT - 3 * coalesce(sum(source_size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS budget,
            sum(w) OVER (ORDER BY n DESC)::BIGINT AS weight FROM r),
        c AS (SELECT *, 3 * source_size * weight <= w * budget AS capped FROM p),
        f AS (SELECT min(n) AS n FROM c WHERE NOT capped),
        t AS (SELECT source, source_size, CASE WHEN capped AND n < coalesce((SELECT n FROM f), n + 1) THEN (3 * source_size)::DOUBLE
            ELSE w * (SELECT c2.budget / c2.weight FROM c c2 WHERE c2.n = (SELECT n FROM f)) END AS target FROM c),
        q AS (SELECT d.*, row_number() OVER () AS row, dense_rank() OVER (ORDER BY d.source NULLS LAST) AS queue, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        e AS (SELECT row, queue, target, source_size * k.range + before AS ahead, size, unnest(range(0, size, 64)) AS head FROM q, range(0, 3) k),
        z AS (SELECT row, queue, least(size, head + 64) - head AS words, ahead + least(size, head + 64) AS place, (ahead + least(size, head + 64)) / target AS finish FROM e),
        o AS (SELECT row, words, coalesce(sum(words) OVER (ORDER BY finish, queue, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS served FROM z),
        g AS (SELECT row, sum(greatest(0, least(words, (SELECT sum(size)::BIGINT FROM d) - served)))::BIGINT AS taken FROM o GROUP BY row)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN g ON q.row = g.row""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
