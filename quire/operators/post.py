"""Stage 8: text clean-up: hyphens, broken characters, spaced capitals, language and OCR confusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import blocks as B

TAIL = rf"{X.WORD}-\s*$"
ALONE = rf"^\s*{X.WORD}+-\s*$"
HEAD = rf"^\s*({X.WORD}+)"


def rejoin(blocks: DataFrame, by: tuple[str, ...] = ("doc_id",), order: tuple[str, ...] = ("page_num", "seq")) -> DataFrame:
    """Words cut at the end of a block get their rest from the next one; blocks that come out blank go.

    A block that is one cut word gives its head away if the block before takes it, and then takes nothing itself.
    Runs of such blocks alternate, so whether one takes follows from its distance to the last block that settles it.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    rows = blocks.withColumn("__t", X.dehyphenate(F.col("text")))
    rows = rows.withColumn("__next", F.lead("__t").over(w)).withColumn("__i", F.row_number().over(w))
    can = F.coalesce(F.col("__t").rlike(TAIL) & F.col("__next").rlike(HEAD), F.lit(False))
    rows = rows.withColumns({"__can": can, "__alone": F.coalesce(F.col("__t").rlike(ALONE), F.lit(False))})
    settled = F.when(~F.col("__can"), F.struct(F.col("__i").alias("i"), F.lit(0).alias("v"))).when(~F.col("__alone"), F.struct(F.col("__i").alias("i"), F.lit(1).alias("v")))
    rows = rows.withColumn("__a", F.coalesce(F.last(settled, ignorenulls=True).over(w), F.struct(F.lit(0).alias("i"), F.lit(0).alias("v"))))
    rows = rows.withColumn("__takes", (F.col("__a.v") + F.col("__i") - F.col("__a.i")) % 2 == 1)
    gave = F.coalesce(F.lag("__takes").over(w), F.lit(False))
    rows = rows.withColumn("__gave", gave)
    left = F.when(F.col("__gave"), F.regexp_replace(F.col("__t"), HEAD, "")).otherwise(F.col("__t"))
    word = F.regexp_extract("__next", HEAD, 1)
    body = F.regexp_replace(left, r"-\s*$", "")
    done = rows.withColumn("text", F.when(F.col("__takes"), F.concat(body, word)).otherwise(left))
    return done.drop("__t", "__next", "__i", "__can", "__alone", "__a", "__takes", "__gave").where(~X.blank(F.col("text")))


def correct(blocks: DataFrame, dictionary: Column | None = None) -> DataFrame:
    """OCR confusions undone in English OCR blocks."""
    fixed = X.fix_confusions(F.col("text")) if dictionary is None else X.fix_confusions_known(F.col("text"), dictionary)
    english = F.col("extraction_method").isin("tesseract_ocr", "surya_ocr") & F.coalesce(F.col("language").startswith("en"), F.lit(False))
    return blocks.withColumn("text", F.when(english, fixed).otherwise(F.col("text")))


def run(blocks: DataFrame, dictionary: Column | None = None) -> DataFrame:
    joined = rejoin(blocks)
    clean = joined.withColumn("text", X.collapse_spaced(X.clean_replacements(F.col("text")))).where(~X.blank(F.col("text")))
    spoken = clean.withColumn("language", X.guess_language(F.col("language"), F.col("text")))
    return correct(spoken, dictionary).select(*B.COLUMNS)
