"""Corpus pipeline: five stages over ``documents``, each an operator of ``grovecast.llm``.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the
columns of ``documents``; the last one returns the token ids.  Every stage works on
all that its predecessor kept, and its result is written before the next reads
it, so a lost executor never repeats earlier stages.

Null, empty and repeated rows follow the operators' own rules: texts without a
letter are rejected by the first stage, copies (equal rows too) become one in the
second, a text of which every byte repeats an earlier one goes in the third.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovecast.llm import bpe, decontamination, language_id, ngram_join, suffix_dedup
from grovecast.llm.common import fresh, materialize, table

TOKENIZER, PIECES = "byte_bpe_50k.json", 100_000
#: The result is token ids: no SQL form (tested against a brute-force version).
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised (operator 5)."""
    model = language_id.fit(docs)
    rejected = fresh(docs, "lang_pred", "score", "rejected")[2]
    return language_id.identify(docs, model).where(~F.col(rejected)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (operator 2)."""
    return ngram_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of earlier documents (operator 1)."""
    got = suffix_dedup.deduplicate(docs)
    return got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else got


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark (operator 10)."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), ids_sha256, decoded_sha256 (operator 6)."""
    # the workers serve all stages: the encoder goes with its task
    got = bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER), decode=True, memory=PIECES, resident=False)
    return got.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("decontaminated", decontaminated), ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
