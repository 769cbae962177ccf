"""One query for each operator of this folder, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normcast.llm.harmonic_packing import pack
from normcast.llm.hash_mixing import mix
from normcast.llm.importance_resampling import resample
from normcast.llm.prefix_sharding import shards
from normcast.llm.quality_rules import judge
from normcast.llm.scratch import new_path
from normcast.llm.segment_langid import identify
from normcast.llm.simhash_dedup import near_duplicates
from normcast.llm.token_files import read_documents, write_token_files
from normcast.llm.topk_search import top_k
from normcast.llm.url_filter import judge as judge_urls

#: Rules of hosts and paths, with their verdicts.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    parts = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_documents(spark, folder, parts).select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge_urls(table(spark, sf_dir, "pages"), URL_RULES, public_tokenizers.path("word_bpe_49k.json"))
    return rows.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_grams", "ratio")


def op6_prefix_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards(table(spark, sf_dir, "documents"), 16)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select(F.col("id").alias("doc_id"), "log_weight", "key", "kept")


def op8_segment_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


def op9_hash_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=3, seed=42, differing=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_topk_search, op2_token_files, op3_url_filter, op4_harmonic_packing, op5_quality_rules, op6_prefix_sharding, op7_importance_resampling, op8_segment_langid, op9_hash_mixing, op10_simhash_dedup)}


#: Every pair of a query and another row.
OP1 = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.v, c.v))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  GROUP BY ALL
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: Sources, caps and budgets as a recursion over sources in order of cap / weight; rows by running sums over their hash.
OP9 = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '') || '|9'), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3]::DOUBLE AS weight
  FROM d GROUP BY source
), c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER o, 0)) /
         (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM s WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size,
         CASE WHEN cap <= weight * level THEN cap
              ELSE weight * (SELECT level FROM c WHERE cap > weight * level ORDER BY cap / weight, source NULLS LAST LIMIT 1) END AS target
  FROM c
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size)) ELSE 0 END AS times FROM t
), r AS (
  SELECT doc_id, size, source_size, target, times, target - times * source_size AS rest,
         sum(size) OVER w AS run, sum(size) OVER g AS n
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
  WINDOW w AS (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         g AS (PARTITION BY d.source, h)
)
SELECT doc_id, size, source_size, target,
       (size * (times + CASE WHEN times < 2 AND (run <= rest OR (run - n <= rest AND run - rest < rest - (run - n))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": OP1, "op9_hash_mixing": OP9}
