"""Training-corpus pipeline: stages over documents, each written and read again by ``run``.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the
columns of ``documents``, but for the last one, which returns ids and decoded texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridelake.llm.benchmark_search import find_passages
from ridelake.llm.jaccard_join import link_documents
from ridelake.llm.quality_rules import keep_documents
from ridelake.llm.queries import tokenizer_file
from ridelake.llm.secret_scan import find_secrets, redacted
from ridelake.llm.sentencepiece_encoding import encode_documents
from ridelake.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is kept (operator 2)."""
    return keep_documents(docs).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id (operator 8).

    Of rows that repeat an id, the first by text, source and language stays; rows without an id
    belong to no group and stay.
    """
    linked = link_documents(docs)
    stay = linked.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(stay.hint("shuffle_hash"), "doc_id", "left_semi")
    first = Window.partitionBy("doc_id").orderBy("text", "source", "lang")
    kept = kept.withColumn("_row", F.row_number().over(first)).where("_row = 1")
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage (operator 4)."""
    found = find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("hits") == 0).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark (operator 5)."""
    clean = redacted(F.col("text"), F.col("secrets"))
    found = find_secrets(docs).withColumn("text", F.when(F.size("secrets") > 0, clean).otherwise(F.col("text")))
    return found.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document that is left (operator 10)."""
    encoded = encode_documents(docs, tokenizer_file("piece_bpe_32k.model"))
    return encoded.select("doc_id", "lang", "source", "piece_ids", "decoded")


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secrets),
    ("sentencepiece", tokens),
]

#: SentencePiece ids cannot be expressed in SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what each returns is a table in the shared folder."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
