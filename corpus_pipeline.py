"""The corpus pipeline: quality, near duplicates, benchmark decontamination, mixture, token files. Each stage is written and read again.

run(spark, sf_dir) applies STAGES to `documents`. The result is the digest of the token files: doc_id, start, n_tokens, ids_crc32.

Every stage takes any rows: a null or empty text is scored like others, is no near duplicate of anything, holds no benchmark item,
is mixed `whole` times and is one end id; rows with a null doc_id are kept by the two joins on it. Repeated rows of one doc_id stay
or go together until the mixture, which takes each. All but the last stage return the columns that they got, whatever
their names. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontam, jaccard, mixing, quality, tokenbin
from tessella.llm._common import dropped, saved, scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.quality_scores(docs, labels).where("predicted = 1").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of five-word shingle sets at a similarity of 0.8."""
    return jaccard.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents to the sources' target weights."""
    return mixing.mix(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mixture's ids as Huffman-coded files and reads them back; a document that the mix repeats has a row for each time."""
    files = tokenbin.write_tokens(docs, scratch(spark, "pipeline-tokens"))
    return tokenbin.read_tokens(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixture", mix_sources),
    ("tokens", write_token_files),
]

#: The classifier and the tokenizer can't be written in SQL; tests compare each stage with its operator, and the operators with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each on the whole result of the one before."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            dropped(before)
        before = docs
    out = saved(STAGES[-1][1](spark, docs, sf_dir), "pipeline-result")
    dropped(docs)
    return out
