"""The operators over the given tables, one query each, with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltemi.llm import (
    attention_lm,
    bpe_automaton,
    bwt_merge,
    chosen_path,
    itq,
    language_id,
    lexical,
    line_chunks,
    merkle,
    source_mix,
    suffix_match,
    token_count,
    toxicity,
)
from meltemi.llm.frames import crc_bucket

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The vocabulary file's text, read where the query is planned."""
    return Path(public_tokenizers.path(VOCABULARY)).read_text(encoding="utf-8")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary())
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = crc_bucket("doc_id", 5) != 0
    model = toxicity.fit(docs.where(learned), labels.where(learned))
    return toxicity.score(docs, model, extra={"held_out": crc_bucket("doc_id", 5) == 0})


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_match.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = docs.where(crc_bucket("doc_id", 7) != 2)
    return attention_lm.score(docs, train, vocabulary(), extra={"held_out": crc_bucket("doc_id", 7) == 2})


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(crc_bucket("doc_id", 3) != 1))
    return language_id.predict(docs, model, extra={"held_out": crc_bucket("doc_id", 3) == 1})


def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_chunks.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_merge.remove_repeats(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.digests(table(spark, sf_dir, "documents"), vocabulary())


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=merkle.even_crc())


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_attention_lm": op4_attention_lm,
    "op5_language_id": op5_language_id,
    "op6_line_chunks": op6_line_chunks,
    "op7_repeated_bytes": op7_repeated_bytes,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_near_vectors": op9_near_vectors,
    "op10_bpe_roundtrip": op10_bpe_roundtrip,
    "op11_lexical_search": op11_lexical_search,
    "op12_source_mix": op12_source_mix,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES: dict[str, str] = {
    "op6_line_chunks": line_chunks.ORACLE,
    "op9_near_vectors": itq.oracle(),
    "op11_lexical_search": lexical.ORACLE,
    "op12_source_mix": source_mix.ORACLE,
    "op13_merkle_manifest": merkle.oracle(),
}
