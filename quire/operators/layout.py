"""Stage 2: layout regions become blocks with harvested text, captions point at figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.config import DEFAULT, EngineConfig
from quire.functions import geometry as G
from quire.functions import text as X
from quire.operators import blocks as B


def fit_regions(regions: DataFrame, pages: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Regions of enough confidence, scaled down together where they leave the page, then clamped to it."""
    on = regions.where(F.coalesce("confidence", F.lit(1.0)) >= cfg.region_min_confidence).join(pages.select(*B.PAGE, "width", "height"), list(B.PAGE))
    w = Window.partitionBy(*B.PAGE)
    mx, my = F.max("bbox.x1").over(w), F.max("bbox.y1").over(w)
    roomy = (F.col("width") > 10) & (F.col("height") > 10)
    far = 1.0 + cfg.coordinate_tolerance
    over = (mx > F.col("width") * far) | (my > F.col("height") * far)
    ratio = lambda size, top: F.when(top > 0, size / top).otherwise(1.0)
    scale = F.when(roomy & over, F.least(ratio(F.col("width"), mx), ratio(F.col("height"), my))).otherwise(1.0)
    sized = on.withColumn("scale", scale)
    box = G.scaled(F.col("bbox"), F.col("scale"))
    return sized.withColumn("bbox", F.when(roomy, G.clamped(box, F.col("width"), F.col("height"))).otherwise(F.col("bbox"))).drop("scale", "width", "height")


def harvest(regions: DataFrame, blocks: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """regions with the joined text of the blocks that lie in them by more than half."""
    have = blocks.where(F.col("bbox").isNotNull() & (G.area(F.col("bbox")) > 0)).select(*B.PAGE, F.col("seq").alias("b_seq"), F.col("text").alias("b_text"), F.col("bbox").alias("b_box"))
    hit = regions.select(*B.PAGE, "region_seq", "bbox").join(have, list(B.PAGE)).where(G.overlap_share(F.col("b_box"), F.col("bbox")) > cfg.harvest_overlap)
    text = hit.groupBy(*B.PAGE, "region_seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b_seq", "b_text"))), lambda x: x["b_text"]), " ").alias("text"))
    return regions.join(text, [*B.PAGE, "region_seq"], "left").withColumn("text", X.strip(F.coalesce("text", F.lit(""))))


def region_blocks(harvested: DataFrame) -> DataFrame:
    rows = harvested.withColumns({"seq": F.col("region_seq"), "block_type": X.label_type(F.coalesce("label", F.lit("Text"))), "extraction_method": F.lit("surya_layout"), "confidence": B.confidence(type_quality=F.coalesce("confidence", F.lit(1.0)))})
    return B.renumber(B.as_blocks(rows, "s2"), F.coalesce("bbox.y0", F.lit(0.0)), F.coalesce("bbox.x0", F.lit(0.0)), F.col("seq"))


def link_captions(blocks: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Each caption's parent is the smallest figure that holds it, the first of equal ones."""
    captions = blocks.where("block_type = 'caption' AND bbox IS NOT NULL").select(*B.PAGE, "block_id", F.col("bbox").alias("c_box"))
    figures = blocks.where("block_type = 'figure' AND bbox IS NOT NULL").select(*B.PAGE, F.col("block_id").alias("figure_id"), F.col("seq").alias("f_seq"), F.col("bbox").alias("f_box"))
    held = captions.join(figures, list(B.PAGE)).where(G.contained(F.col("c_box"), F.col("f_box"), cfg.caption_pad))
    best = held.groupBy("doc_id", "block_id").agg(F.min_by("figure_id", F.struct(G.area(F.col("f_box")), "f_seq")).alias("figure_id"))
    return blocks.join(best, ["doc_id", "block_id"], "left").withColumn("parent_id", F.coalesce("figure_id", "parent_id")).select(*B.COLUMNS)


def run(pages: DataFrame, blocks: DataFrame, regions: DataFrame, cfg: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(blocks, warnings): regions first, then what was there; pages without regions keep theirs or get one empty block."""
    fitted = fit_regions(regions, pages, cfg)
    made = link_captions(region_blocks(harvest(fitted, blocks, cfg)), cfg)
    bare = pages.join(fitted.select(*B.PAGE).distinct(), list(B.PAGE), "left_anti")
    empty = bare.join(blocks.select(*B.PAGE).distinct(), list(B.PAGE), "left_anti")
    full = G.bbox(F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height"))
    fallback = B.as_blocks(empty.withColumns({"seq": F.lit(0), "bbox": full, "extraction_method": F.lit("surya_layout"), "confidence": B.confidence(type_quality=F.lit(0.3))}).select(*B.PAGE, "seq", "bbox", "extraction_method", "confidence"), "s2-fallback")
    return B.append(made.unionByName(fallback), blocks), B.warnings(bare, 2, F.lit("stage2: no layout regions, existing blocks kept"))
