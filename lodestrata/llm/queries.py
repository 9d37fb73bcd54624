"""The queries of this subpackage and, where SQL can express one, the SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontam, exact_dedup, langid, linededup, lm, packing, quality, sharding, simhash, warc
from lodestrata.llm.common import fold_bucket


#: Bytes of a shard: small, so that the directory splits at every size of the tables.
OP6_LIMIT = 1 << 20


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer() -> tuple[str, str]:
    """Path and word pattern of the public byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), *tokenizer())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(_read(spark, sf_dir, "documents"))
    return found.select(F.col("_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))
    return found.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    learned = fold_bucket(F.col("doc_id"), 4) != 2
    model = quality.train(docs.where(learned), _read(spark, sf_dir, "labels").where(learned))
    found = quality.score(docs, model)
    return found.select(F.col("_row.doc_id").alias("doc_id"), (fold_bucket(F.col("_row.doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign_shards(_read(spark, sf_dir, "documents"), OP6_LIMIT)
    return found.select(F.col("_key").alias("doc_id"), "n_bytes", "shard", F.col("depth").cast("long").alias("depth"), "shard_bytes", "shard_docs")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return warc.search(warc.write_archive(pages), pages).drop("url")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold_bucket(F.col("doc_id"), 5) == 0
    found = langid.identify(docs, langid.train(docs.where(~held_out)))
    return found.select(F.col("_row.doc_id").alias("doc_id"), (fold_bucket(F.col("_row.doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.line_decisions(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("_id").alias("doc_id"), "n_lines", "n_removed", F.concat_ws(",", F.transform("kept_lines", lambda x: x.cast("string"))).alias("kept_lines"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return found.select(F.col("_row.doc_id").alias("doc_id"), F.col("item_id").isNotNull().alias("contaminated"), "item_id", F.col("matched").alias("matched_windows"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
     b AS (SELECT doc_id, n_bytes, h, depth, sum(n_bytes) OVER w AS shard_bytes, count(*) OVER w AS shard_docs
           FROM d, range(0, 61) r(depth) WINDOW w AS (PARTITION BY depth, h >> (60 - depth)))
SELECT doc_id, n_bytes, substr(lpad(bin(h >> (60 - depth)), 60, '0'), (61 - depth)::BIGINT) AS shard,
       depth, shard_bytes::BIGINT AS shard_bytes, shard_docs
FROM b WHERE shard_bytes <= {OP6_LIMIT} OR shard_docs = 1
QUALIFY depth = min(depth) OVER (PARTITION BY doc_id)
"""

OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
     t AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS top FROM p)
SELECT page_id, payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to FROM t
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_packing": op1_packing, "op2_simhash": op2_simhash, "op3_lm": op3_lm, "op4_exact_dedup": op4_exact_dedup, "op5_quality": op5_quality, "op6_sharding": op6_sharding, "op7_langid": op7_langid, "op8_line_dedup": op8_line_dedup, "op9_decontamination": op9_decontamination, "op10_warc": op10_warc}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op6_sharding": OP6_SQL, "op10_warc": OP10_SQL}
