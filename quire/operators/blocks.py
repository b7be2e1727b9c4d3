"""The block table: constructors, deterministic ids, checks and small shared transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.schema import DEFAULTS

PAGE = ("doc_id", "page_num")
COLUMNS = ("doc_id", "page_num", "seq", "block_id", "text", "bbox", "block_type", "extraction_method", "confidence", "parent_id", "language", "script_direction")


def block_id(stage: str, *parts: Column) -> Column:
    """The same id at every run and retry, shaped like a UUID."""
    h = F.md5(F.concat_ws("|", F.lit(stage), *[p.cast("string") for p in parts]))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def confidence(**given: Column) -> Column:
    return F.struct(*(F.coalesce(given.get(k, F.lit(v)), F.lit(v)).cast("double").alias(k) for k, v in DEFAULTS.items()))


def with_confidence(df: DataFrame, **given: Column) -> DataFrame:
    """df with some parts of its confidence replaced."""
    c = F.col("confidence")
    for k, v in given.items():
        c = c.withField(k, v)
    return df.withColumn("confidence", c)


def as_blocks(df: DataFrame, stage: str) -> DataFrame:
    """df with the block columns it lacks, in order."""
    made = {
        "block_id": block_id(stage, F.col("doc_id"), F.col("page_num"), F.col("seq")),
        "text": F.lit(""), "bbox": F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>"), "block_type": F.lit("body"), "extraction_method": F.lit("pymupdf_direct"),
        "confidence": confidence(), "parent_id": F.lit(None).cast("string"), "language": F.lit(None).cast("string"), "script_direction": F.lit("ltr"),
    }
    return df.select(*(F.col(c) if c in df.columns else made[c].alias(c) for c in COLUMNS))


def renumber(df: DataFrame, *order: Column) -> DataFrame:
    """seq made dense again, per page, in the given order."""
    return df.withColumn("seq", (F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order)) - 1).cast("int"))


def append(first: DataFrame, then: DataFrame) -> DataFrame:
    """The blocks of either table, those of `then` after those of `first` on each page."""
    both = first.withColumn("__part", F.lit(0)).unionByName(then.withColumn("__part", F.lit(1)))
    return renumber(both, F.col("__part"), F.col("seq"), F.col("block_id")).drop("__part")


def warnings(df: DataFrame, stage: int, message: Column) -> DataFrame:
    seq = F.col("seq") if "seq" in df.columns else F.lit(0)
    return df.select("doc_id", "page_num", F.lit(stage).alias("stage"), seq.cast("int").alias("seq"), message.alias("msg"))


def dangling_parents(blocks: DataFrame) -> DataFrame:
    """Blocks whose parent_id names no block of their document."""
    ids = blocks.select("doc_id", F.col("block_id").alias("parent_id"))
    return blocks.where(F.col("parent_id").isNotNull()).join(ids, ["doc_id", "parent_id"], "left_anti")


def duplicate_ids(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("block_id").count().where("count > 1")


def counts(blocks: DataFrame) -> DataFrame:
    """Blocks, words and characters of each document."""
    from quire.functions.text import words

    return blocks.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum(F.size(words(F.col("text")))).alias("n_words"), F.sum(F.length("text")).alias("n_chars"))
