"""The corpus pipeline: quality, near copies, repeated passages, benchmark leaks, then windows.

Each stage works on all that its predecessor kept and is written as Parquet in the shared folder before the next
one reads it, so a lost executor costs a stage's tasks at most, never the stages before it. What a stage has read is
deleted once its own rows are written; the rows of the last stage stay.

Defined results (those of the operators hold for each stage)
  null or empty text   kept by every stage before packing, whatever its score; not packed
  null doc_id          never a near copy nor cut; judged, searched for leaks and packed like any other
  no labels            nothing is rejected
  repeated rows        one document to the near copies and passages: all of them stay; each is packed
  ties                 of near copies the smallest doc_id stays, of passages the first place in it
  empty table          no windows
  extra columns        kept by all stages but packing, whatever their names
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quire.llm import chunks, decontaminate, jaccard, packing, quality
from quire.llm.common import remove, shared_folder, table
from quire.llm.queries import TOKENIZER


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chunks.dedup(docs, length_col="n_chars")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_windows(docs, tokenizer=TOKENIZER)


STAGES = [("quality", good_quality), ("near_duplicates", near_duplicates), ("substring_dedup", repeated_passages), ("decontamination", benchmark_leaks), ("packing", windows)]

#: SQL can express neither the zstandard model, content-defined chunks nor online packing; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
