"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame,
which is written as Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``docs``. Rows travel as one struct, so columns of any name, extra ones too, pass unharmed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normcast.llm.harmonic_packing import pack
from normcast.llm.hash_mixing import mixed
from normcast.llm.importance_resampling import resample
from normcast.llm.scratch import written
from normcast.llm.segment_langid import UNDETERMINED, identify
from normcast.llm.shingle_dedup import one_of_each

#: A document is rejected where the best language explains it by less than this share of what it explains of its own
#: texts, beyond a background of equally likely pieces: below 0 that background explains a document better.
LEAST_FIT = 0.1


def _carried(docs: DataFrame, *needed: str) -> DataFrame:
    return docs.select(*needed, F.struct(*[docs[c] for c in docs.columns]).alias("__row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what importance resampling towards good, non-toxic labelled documents takes."""
    rows = resample(_carried(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("__row",))
    return rows.filter("kept").select("__row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those in none of the learned languages, which a background explains as well."""
    rows = identify(_carried(docs, "doc_id", "text", "lang"), public_tokenizers.path("piece_bpe_32k.model"), carry=("__row",))
    return rows.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("fit") >= LEAST_FIT)).select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each component of near-duplicates (Jaccard of 5-word shingles 0.8 or more) the row with the smallest id.

    SimHash blocks can't find that similarity; ``shingle_dedup`` says why, and what stands in for them."""
    return one_of_each(docs, width=5, similarity=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every source's documents none, one or two times, towards its budget."""
    return mixed(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all ids into sequences of 1,024: one row for each piece."""
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", packing)]

#: No stage but the mixture can be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
