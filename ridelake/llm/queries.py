"""Registered queries of the operators: thin digests over whole tables, and their check SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelake.llm import oracles
from ridelake.llm.benchmark_search import covered_words, find_passages, matched_items
from ridelake.llm.conversation_repair import audit_conversations, damaged, repaired_digests
from ridelake.llm.jaccard_join import link_documents
from ridelake.llm.license_scan import find_licenses, fit
from ridelake.llm.merkle_manifest import leaf_hash, lowered, verify_documents
from ridelake.llm.preference_format import format_preferences, neighbours
from ridelake.llm.quality_rules import STATISTICS, judge_documents
from ridelake.llm.secret_scan import find_secrets, listed
from ridelake.llm.sentencepiece_encoding import encode_documents
from ridelake.llm.substring_dedup import drop_repeated_runs
from ridelake.llm.suffix_dedup import drop_repeated_strings
from ridelake.llm.token_files import read_token_files, write_token_files
from ridelake.llm.url_filter import LISTED_LABELS, host_and_path, judge_urls
from ridelake.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query with the SQL of its rows, where SQL can express them."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op10_sentencepiece_encoding")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    encoded = encode_documents(docs, tokenizer_file("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op9_substring_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    kept = drop_repeated_runs(table(spark, folder, "documents").select("doc_id", "text"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op1_suffix_array_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    kept = drop_repeated_strings(table(spark, folder, "documents").select("doc_id", "text"), length=50)
    digest = F.sha2("kept_bytes", 256).alias("kept_sha256")
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", digest)


@query("op4_benchmark_decontamination")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find_passages(docs, table(spark, folder, "benchmark"))
    items = F.sort_array(matched_items().cast("array<string>"))
    return found.select(
        "doc_id",
        "n_words",
        covered_words().alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


@query("op2_quality_rules", oracles.QUALITY)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge_documents(table(spark, folder, "documents"))
    return judged.select("doc_id", *STATISTICS, "base_failed", "kept")


@query("op5_secret_scans", oracles.SECRETS)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    kinds = F.transform("secrets", lambda s: s["kind"])
    counts = [
        F.size(F.filter(kinds, lambda k: k == F.lit(kind))).cast("long").alias(f"n_{kind}")
        for kind in ("assign", "access", "hex")
    ]
    return found.select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans")
    )


@query("op6_url_filters", oracles.URLS)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    host, _ = host_and_path(F.col("url"))
    hosts = pages.select(host.alias("host")).distinct()
    labels = F.array(*[F.lit(x) for x in LISTED_LABELS])
    return judge_urls(pages, hosts.where(F.arrays_overlap(F.split("host", r"\."), labels)))


@query("op3_preference_format", oracles.PREFERENCES)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    made = format_preferences(neighbours(turns), turns)
    spans = {
        c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["begin"], s["stop"])), ",").alias(c)
        for c in ("chosen_mask", "rejected_mask")
    }
    return made.select(
        "pair_id",
        "n_prompt_turns",
        *[F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")],
        *spans.values(),
    )


@query("op8_ngram_jaccard_join")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return link_documents(table(spark, folder, "documents").select("doc_id", "text"), shingle=5, percent=75)


@query("op7_license_scans")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find_licenses(docs, fit(docs)).select("doc_id", "family", "confirmed")
    every = docs.select("doc_id", F.lit(None).cast("string").alias("family"), F.lit(None).cast("boolean").alias("confirmed"))
    families = F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",")
    return (
        every.unionByName(found)
        .groupBy("doc_id")
        .agg(
            F.count_if("confirmed").alias("n_licenses"),
            families.alias("families"),
            F.count_if(~F.col("confirmed")).alias("n_unconfirmed"),
        )
    )


@query("op11_token_output")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    written = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, tokenizer_file("word_bpe_49k.json"), written, end_id=2)
    return read_token_files(spark, written).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op13_merkle_manifest", oracles.MERKLE)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    # Every document whose id has a checksum divisible by 5 is checked with its letters lowered.
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    tampered = F.when(chosen, leaf_hash(lowered()))
    found = verify_documents(docs, f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}", tampered)
    return found.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", "verified")


@query("op12_conversation_repair", oracles.REPAIRS)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    rows = damaged(turns)
    audits = audit_conversations(rows, by_text=True)
    path = f"{shared_folder(spark)}/audits-{uuid.uuid4().hex}"
    audits.write.parquet(path)
    audits = spark.read.parquet(path)
    # Conversations that lost all their rows have nothing to repair.
    digests = repaired_digests(rows, audits, by_text=True).withColumnRenamed("conv_id", "_conv")
    found = audits.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")))
    every = turns.select(F.col("conv_id").alias("_id")).distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
