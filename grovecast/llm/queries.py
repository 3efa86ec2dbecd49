"""Thin registered queries: each applies one operator to its whole table with
production parameters and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovecast.llm import (bpe, chat, decontamination, language_id, merkle, ngram_join, periodic_runs, quality, quality_classifier,
                           sharding, suffix_dedup, token_store, url_filter)
from grovecast.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

BYTE_BPE, WORD_BPE, WORD_END = "byte_bpe_50k.json", "word_bpe_49k.json", 2
N_SHARDS = 24
KEEP_SCORE = 0.7
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
EXTRA_CONVERSATION = (-1, "</s>[INST] ok [/INST]")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text without the 50-byte strings of earlier documents."""
    got = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and copies of every document (5 words, similarity 0.8 or more)."""
    got = ngram_join.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "class_id", "n_links", "n_copies")


@query
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back."""
    number, text = EXTRA_CONVERSATION
    extra = spark.range(2).select(F.lit(number).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(text).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = chat.format_chat(chat.events_from_rows(rows))
    return chat.digests(chat.materialize(formatted, "chat"))


@query
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url judged by rule, else by template."""
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text; learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, learn=~language_id.held_out())
    named = docs.select("doc_id", "text", language_id.held_out().alias("held_out"))
    return (language_id.identify(named, model)
            .select("doc_id", "held_out", "lang_pred", "score", "rejected"))


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded."""
    got = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), decode=True)
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every whole text, base rules and adaptive verdict."""
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


@query
def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as Huffman-coded token files and read back."""
    path = token_store.new_store(spark)
    token_store.write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE), WORD_END)
    return token_store.read_store(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    got = sharding.histogram_shards(table(spark, sf_dir, "documents"), N_SHARDS)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every whole text."""
    got = decontamination.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", F.size("hits").cast("bigint").alias("n_hit"),
                      F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      (F.size("hits") > 0).alias("contaminated"))


@query
def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text; learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), learn=~quality_classifier.held_out())
    return quality_classifier.classify(docs, model).select(
        "doc_id", quality_classifier.held_out().alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Merkle tree over all rows; every second id's text is tampered with and checked against it."""
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    fields = [F.col(c) for c in merkle.FIELDS[:-1]]
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(odd, merkle.leaf(*fields, F.translate("text", "\n", "")))
    got = merkle.manifest(docs, carry={"tampered": tampered})
    got = merkle.verify(got.withColumn("suspect", F.coalesce("tampered", "leaf")), "suspect")
    return got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every whole text, a tenth of which end in a planted one."""
    docs = periodic_runs.with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    got = periodic_runs.find_runs(docs, keep_text=False).withColumn("best", periodic_runs.longest_exponent(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return got.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
                      F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                      F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
