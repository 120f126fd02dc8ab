"""The corpus pipeline: language, exact copies, near copies, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first four return the columns of
documents; the last returns the token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, exact_dedup, language_id, mixing, near_dedup
from tidemark.llm.runtime import cut


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no learned language: null text and text without a letter."""
    return language_id.drop_unknown(spark, docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.drop_copies(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; of each component the smallest doc_id stays."""
    return near_dedup.keep_one(spark, docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the curriculum plays a document, range-sorted by training position; as files, their order is that of the plays."""
    return mixing.training_order(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, position (the place in the training order), n_tokens, ids, and whether the ids decode to the text's bytes."""
    plays = mixing.read_order(docs).select("row.doc_id", "row.text", "position")
    found = byte_bpe.round_trip(spark, plays, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, carry=("position",))
    return found.select(F.col("id").alias("doc_id"), "row.position", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("same").alias("round_trip"))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode_tokens),
]

#: Language models, MinHash components and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
