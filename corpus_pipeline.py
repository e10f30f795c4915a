"""The corpus pipeline: from `documents` to token ids in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the
columns of documents; the last returns the tokens. `run` writes each stage as Parquet in the
shared folder and reads it again, so a lost executor costs no more than the stage it was in.

Documents are told apart by doc_id, as in the given table; a null doc_id is a document of its own
id. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logveil.llm import bpe, decontamination, line_dedup, quality, simhash_dedup
from logveil.llm.queries import vocabulary
from logveil.scratch import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the line labeller."""
    field = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.retained(docs.select(*COLUMNS), field)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three-line windows repeat."""
    out = line_dedup.remove_repeated_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of fingerprints linked at three bits or fewer, the document with the least id."""
    return simhash_dedup.one_of_each(docs.select(*COLUMNS), shingle=3, radius=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's windows do not cover to one word in twenty or more."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.retained(docs.select(*COLUMNS), benchmark)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the ids of each text, and a digest of what they decode to."""
    tokens = bpe.round_trip(docs, vocabulary())
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("decontamination", decontaminate),
    ("encoding", encode),
]

#: Training, fingerprints and merges have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, step) in enumerate(STAGES):
        docs = stage(step(spark, docs, sf_dir), f"stage-{number}")
    return docs
