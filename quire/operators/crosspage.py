"""Stage 7: what repeats across the pages of a document, and how its headings nest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import DEFAULT, EngineConfig
from quire.functions import geometry as G
from quire.functions import text as X
from quire.lineage import cut
from quire.operators import blocks as B


def zones(blocks: DataFrame, pages: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """doc_id, page_num, block_id, fp, top and bottom: membership of the head and foot of the page.

    Where no block lies in a zone, the first or last few that are not in the other zone stand in.
    """
    height = F.coalesce(F.nullif("height", F.lit(0.0)), F.lit(cfg.default_page_height))
    own = blocks.where(F.col("bbox").isNotNull() & ~X.blank(F.col("text"))).select(*B.PAGE, "seq", "block_id", "bbox", X.fingerprint(F.col("text")).alias("fp")).join(pages.select(*B.PAGE, height.alias("page_height")), list(B.PAGE))
    mid = (F.col("bbox.y0") + F.col("bbox.y1")) / 2
    page = Window.partitionBy(*B.PAGE)
    rows = own.withColumns({"in_top": mid < F.col("page_height") * cfg.zone_share, "in_bottom": mid > F.col("page_height") * (1 - cfg.zone_share), "down": F.row_number().over(page.orderBy("bbox.y0", "seq"))})
    rows = rows.withColumns({"n": F.count("*").over(page), "any_top": F.max("in_top").over(page), "any_bottom": F.max("in_bottom").over(page)})
    top = F.when(F.col("any_top"), F.col("in_top")).otherwise((F.col("down") <= cfg.zone_blocks) & ~F.col("in_bottom"))
    bottom = F.when(F.col("any_bottom"), F.col("in_bottom")).otherwise((F.col("down") > F.col("n") - cfg.zone_blocks) & ~F.col("in_top"))
    return rows.select(*B.PAGE, "block_id", "fp", top.alias("top"), bottom.alias("bottom"))


def repeating(zoned: DataFrame, min_pages: int = DEFAULT.min_pages) -> DataFrame:
    """doc_id, fp, header and footer: fingerprints on enough distinct pages at the head or the foot."""
    pages = lambda z: F.size(F.collect_set(F.when(F.col(z), F.col("page_num")))) >= min_pages
    by = zoned.where("fp <> '' AND (top OR bottom)").groupBy("doc_id", "fp").agg(pages("top").alias("header"), pages("bottom").alias("footer"))
    return by.where("header OR footer")


def promote(blocks: DataFrame, pages: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """blocks with repeated heads and feet typed header and footer; a header wins."""
    zoned = zones(blocks, pages, cfg).where("fp <> '' AND (top OR bottom)")
    hit = zoned.join(repeating(zoned, cfg.min_pages), ["doc_id", "fp"])
    kind = F.when(F.col("top") & F.col("header"), "header").when(F.col("bottom") & F.col("footer"), "footer")
    told = hit.select("doc_id", "block_id", kind.alias("kind")).where("kind IS NOT NULL")
    return blocks.join(told, ["doc_id", "block_id"], "left").withColumn("block_type", F.coalesce("kind", "block_type")).select(*B.COLUMNS)


def upper_median(values: Column) -> Column:
    """The upper of the two middle values."""
    s = F.array_sort(F.collect_list(values))
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def body_heights(blocks: DataFrame) -> DataFrame:
    high = G.height(F.col("bbox"))
    return blocks.where((F.col("block_type") == "body") & F.col("bbox").isNotNull() & (high > 0)).groupBy(*B.PAGE).agg(upper_median(high).alias("body_height"))


def guess_headings(blocks: DataFrame, cfg: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(blocks, warnings): body blocks that look like headings, on pages that only OCR has read and that have no heading yet."""
    only = F.bool_and(F.col("extraction_method").isin("tesseract_ocr", "surya_ocr") & (F.col("block_type") != "heading"))
    scanned = blocks.groupBy(*B.PAGE).agg(only.alias("scanned")).where("scanned")
    on = blocks.join(scanned, list(B.PAGE), "left").join(body_heights(blocks), list(B.PAGE), "left")
    like = X.looks_like_heading(F.col("text"), G.height(F.col("bbox")), F.coalesce("body_height", F.lit(0.0)), cfg.heading_ratio, cfg.heading_chars)
    hit = F.coalesce(F.col("scanned") & (F.col("block_type") == "body") & F.col("bbox").isNotNull() & like, F.lit(False))
    marked = on.withColumn("hit", hit)
    out = marked.withColumn("block_type", F.when(F.col("hit"), "heading").otherwise(F.col("block_type"))).select(*B.COLUMNS)
    n = marked.groupBy(*B.PAGE).agg(F.count_if("hit").alias("n")).where("n > 0")
    return out, B.warnings(n, 7, F.format_string("stage7: %d heading(s) found by shape", F.col("n")))


def level_heights(heights: Column, gap: float = DEFAULT.level_gap) -> Column:
    """Distinct heights to one decimal, tallest first, those within `gap` of the last kept one left out."""
    tall = F.reverse(F.array_sort(F.array_distinct(F.transform(heights, lambda h: F.bround(h, 1)))))
    start = F.array().cast("array<double>")
    return F.aggregate(tall, start, lambda acc, h: F.when((F.size(acc) == 0) | (F.abs(h - F.get(acc, F.size(acc) - 1)) > gap), F.array_append(acc, h)).otherwise(acc))


def nearest_level(high: Column, levels: Column) -> Column:
    return F.array_min(F.transform(levels, lambda l, i: F.struct(F.abs(high - l).alias("d"), i.alias("i"))))["i"]


def heading_levels(blocks: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """block_id and level (0 is the top) of the headings of each document."""
    own = blocks.where("block_type = 'heading' AND bbox IS NOT NULL").select(*B.PAGE, "seq", "block_id", F.col("bbox.y0").alias("y0"), G.line_height(F.col("bbox"), F.col("text")).alias("high"))
    levels = own.groupBy("doc_id").agg(level_heights(F.collect_set(F.bround("high", 1)), cfg.level_gap).alias("levels"))
    return own.join(levels, "doc_id").select(*B.PAGE, "seq", "block_id", "y0", "high", nearest_level(F.col("high"), F.col("levels")).alias("level"))


def heading_parents(levels: DataFrame) -> DataFrame:
    """levels with parent_id: the last heading before of a smaller level, if that is exactly one smaller."""
    levels = cut(levels)
    deepest = levels.agg(F.max("level").alias("n")).first()["n"] or 0
    w = Window.partitionBy("doc_id").orderBy("page_num", "y0", "seq").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda k: F.last(F.when(F.col("level") < k, F.struct(F.col("level").cast("int").alias("level"), F.col("block_id").alias("id"))), ignorenulls=True).over(w)
    none = F.lit(None).cast("struct<level:int,id:string>")
    parent = F.get(F.array(none, *[last(k) for k in range(1, deepest + 1)]), F.col("level"))
    found = levels.withColumn("__p", parent)
    return found.withColumn("parent_id", F.when(F.col("__p.level") == F.col("level") - 1, F.col("__p.id"))).drop("__p")


def nest_headings(blocks: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    found = heading_parents(heading_levels(blocks, cfg)).select("doc_id", "block_id", F.col("parent_id").alias("__parent"))
    return blocks.join(found, ["doc_id", "block_id"], "left").withColumn("parent_id", F.coalesce("__parent", "parent_id")).select(*B.COLUMNS)


def heading_depths(blocks: DataFrame, most: int = DEFAULT.max_heading_depth) -> DataFrame:
    """block_id and depth (1 to `most`) of each heading: steps to the top, or its height's rank where it has no parent."""
    own = blocks.where("block_type = 'heading'").select("doc_id", "block_id", "parent_id", F.when(F.col("bbox").isNotNull(), G.height(F.col("bbox"))).alias("high"))
    chain = own.select("doc_id", "block_id", "parent_id", "high", F.lit(1).alias("depth"), F.col("parent_id").alias("up"))
    link = blocks.select("doc_id", F.col("block_id").alias("up"), F.col("parent_id").alias("above"), F.lit(1).alias("one"))
    for _ in range(most - 1):
        chain = chain.join(link, ["doc_id", "up"], "left").select("doc_id", "block_id", "parent_id", "high", (F.col("depth") + F.coalesce("one", F.lit(0))).alias("depth"), F.col("above").alias("up"))
    tall = own.where("high > 0").groupBy("doc_id").agg(F.reverse(F.array_sort(F.collect_set("high"))).alias("tall"), F.count("*").alias("n"))
    near = F.transform("tall", lambda h: F.abs(F.col("high") - h) < 2.0)
    rank = F.when((F.col("n") > 1) & F.col("high").isNotNull(), F.nullif(F.array_position(near, True), F.lit(0)))
    out = chain.join(tall, "doc_id", "left")
    depth = F.when((F.col("depth") == 1) & (F.coalesce("parent_id", F.lit("")) == ""), F.least(F.coalesce(rank, F.lit(1)), F.lit(most))).otherwise(F.col("depth"))
    return out.select("doc_id", "block_id", depth.cast("int").alias("depth"))


def run(pages: DataFrame, blocks: DataFrame, cfg: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    typed = cut(promote(blocks, pages, cfg))
    changed = typed.alias("n").join(blocks.select("doc_id", "block_id", F.col("block_type").alias("was")), ["doc_id", "block_id"]).where("block_type <> was").groupBy("doc_id").agg(F.count("*").alias("n"))
    said = B.warnings(changed.withColumn("page_num", F.lit(None).cast("int")), 7, F.format_string("stage7: %d repeating block(s) typed header or footer", F.col("n")))
    headed, more = guess_headings(typed, cfg)
    nested = cut(nest_headings(cut(headed), cfg))
    broken = B.dangling_parents(nested)
    lost = B.warnings(broken, 7, F.format_string("stage7: block %s on page %d names an unknown parent %s", "block_id", "page_num", "parent_id"))
    return nested, said.unionByName(more).unionByName(lost)
