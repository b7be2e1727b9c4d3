"""Stage 6: native lines go into the layout regions that hold them, without doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.config import DEFAULT, EngineConfig
from quire.functions import geometry as G
from quire.functions import text as X
from quire.operators import blocks as B
from quire.schema import NATIVE


def claims(native: DataFrame, regions: DataFrame) -> DataFrame:
    """block_id and region_id: each native block goes to the first region that holds its centre."""
    n = native.where("bbox IS NOT NULL").select(*B.PAGE, "block_id", F.col("bbox").alias("n_box"))
    r = regions.where("bbox IS NOT NULL").select(*B.PAGE, F.col("block_id").alias("region_id"), F.col("seq").alias("r_seq"), F.col("bbox").alias("r_box"))
    held = n.join(r, list(B.PAGE)).where(G.center_inside(F.col("n_box"), F.col("r_box")))
    return held.groupBy("doc_id", "block_id").agg(F.min_by("region_id", "r_seq").alias("region_id"))


def merge(regions: DataFrame, native: DataFrame, claimed: DataFrame, quality: float = DEFAULT.native_quality) -> tuple[DataFrame, DataFrame]:
    """(blocks, warnings) for regions with claimed lines: good native text wins, else the region's own."""
    lines = native.join(claimed, ["doc_id", "block_id"])
    said = F.filter(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("bbox.y0", F.lit(0.0)), F.coalesce("bbox.x0", F.lit(0.0)), "seq", "text"))), lambda l: l["text"]), lambda t: t != "")
    by = lines.groupBy("doc_id", "region_id").agg(F.coalesce(F.avg("confidence.text_quality"), F.lit(0.0)).alias("q"), X.strip(F.array_join(said, "\n")).alias("native_text"), F.min_by(F.struct("language", "script_direction"), "seq").alias("lead"))
    on = regions.join(by.withColumnRenamed("region_id", "block_id"), ["doc_id", "block_id"])
    good = F.col("q") > quality
    c = F.col("confidence")
    out = on.withColumns({
        "text": F.when(good, F.col("native_text")).otherwise(X.strip(F.coalesce("text", F.lit("")))),
        "extraction_method": F.when(good, "pymupdf_direct").otherwise("surya_layout"),
        "confidence": B.confidence(text_quality=F.col("q"), order_quality=c["order_quality"], type_quality=c["type_quality"], method_score=F.when(good, 1.0).otherwise(0.6)),
        "language": F.when(good, F.col("lead.language")), "script_direction": F.when(good, F.col("lead.script_direction")).otherwise("ltr"), "parent_id": F.lit(None).cast("string"),
        "block_id": B.block_id("s6", F.col("block_id")),
    })
    empty = on.where(~good & X.blank(F.col("text"))).select(*B.PAGE, "seq", F.concat(F.lit("stage6:needs_ocr block_id="), B.block_id("s6", F.col("block_id"))).alias("m"))
    return out.select(*B.COLUMNS), B.warnings(empty, 6, F.col("m"))


def run(blocks: DataFrame, cfg: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(blocks, warnings). Pages with only one kind of block stay as they are."""
    native_one = F.col("extraction_method").isin(*NATIVE)
    both = blocks.groupBy(*B.PAGE).agg(F.count_if(native_one).alias("n"), F.count("*").alias("all")).where("n > 0 AND n < all").select(*B.PAGE)
    mixed, pure = blocks.join(both, list(B.PAGE), "left_semi"), blocks.join(both, list(B.PAGE), "left_anti")
    native, regions = mixed.where(native_one), mixed.where(~native_one)
    claimed = claims(native, regions)
    merged, warned = merge(regions, native, claimed, cfg.native_quality)
    used = claimed.select("doc_id", F.col("region_id").alias("block_id")).distinct()
    alone = regions.join(used, ["doc_id", "block_id"], "left_anti")
    free = native.join(claimed.select("doc_id", "block_id"), ["doc_id", "block_id"], "left_anti")
    need = B.warnings(alone.where(X.blank(F.col("text"))), 6, F.concat(F.lit("stage6:needs_ocr block_id="), F.col("block_id")))
    parts = merged.unionByName(alone.select(*B.COLUMNS)).withColumn("__free", F.lit(0)).unionByName(free.select(*B.COLUMNS).withColumn("__free", F.lit(1)))
    key = lambda c: F.when(F.col("__free") == 0, F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0)
    done = B.renumber(parts, F.col("__free"), key("bbox.y0"), key("bbox.x0"), F.col("seq"), F.col("block_id")).select(*B.COLUMNS)
    return done.unionByName(pure.select(*B.COLUMNS)), warned.unionByName(need)
