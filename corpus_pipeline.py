"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlake.llm.common import checkpoint_folder, remainder
from packetlake.llm.langid import keep_identified, train
from packetlake.llm.linededup import dedup_lines
from packetlake.llm.mixing import mix
from packetlake.llm.neardedup import dedup_near_copies
from packetlake.llm.packing import pack_documents

#: Below this posterior nothing tells the languages apart: of four, each then has a quarter.
LEAST_POSTERIOR = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those of no language rather than another, go.

    Null and empty texts go; repeated rows stay or go together; extra columns stay. Empty tables stay empty.
    """
    model = train(docs.where(remainder(F.col("doc_id"), 5) != 0))
    return keep_identified(docs, model, LEAST_POSTERIOR)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go, and with them the documents that consist of nothing else.

    A null text has no lines and stays; repeated rows are one document and stay alike; extra columns stay.
    """
    out = dedup_lines(docs, lines="_lines", deleted="_deleted").where((F.col("_deleted") == 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.when(F.col("_deleted") == 0, F.col("n_chars")).otherwise(F.length("text")).cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; of null and empty texts, and of repeated rows, one."""
    return dedup_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is replicated to its weight, and all copies are shuffled.

    A null source is a source of its own; texts aren't read; repeated rows are drawn alike. Extra columns stay.
    """
    return mix(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in the sequences; a null text is its end alone."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("packing", packing),
]

#: SQL can express neither a trained model nor a tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage keeps is written to the shared checkpoint folder and read again.

    A stage's folder is deleted when the next one is written; the last one's stays, as the result reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/corpus_pipeline-{uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
