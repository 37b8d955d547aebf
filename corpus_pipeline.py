"""The training-data pipeline over `documents`: five stages, each on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltemi.llm import bpe_automaton, chosen_path, line_chunks, suffix_match, toxicity
from meltemi.llm.frames import crc_bucket, settled
from meltemi.llm.queries import table, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. It learns from labelled documents outside the held-out fold."""
    learned = crc_bucket("doc_id", 5) != 0
    model = toxicity.fit(docs.where(learned), table(spark, sf_dir, "labels").where(learned))
    return toxicity.accepted(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines leave the texts; every document stays, with its text and its length as they are then."""
    carried = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    out = line_chunks.dedup_lines(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in carried.items()]), key=carried["doc_id"], text=carried["text"], paired=True)
    now = {"text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    return out.select(*[now.get(f.name, F.col(carried[f.name])).cast(f.dataType).alias(f.name) for f in docs.schema.fields])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id stays."""
    gone = chosen_path.near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a window of a benchmark item go."""
    return suffix_match.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to."""
    out = bpe_automaton.encode(docs, vocabulary())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: The toxicity model, the near-duplicate groups and the encoding are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage reads what the one before it has written as Parquet."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = settled(out, f"pipeline-{name}") if k + 1 < len(STAGES) else out
    return docs
