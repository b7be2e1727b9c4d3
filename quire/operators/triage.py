"""Stage 0: what each page needs, from its text density and image coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import DEFAULT, EngineConfig
from quire.functions import geometry as G
from quire.functions import text as X


def rule(chars: Column, union: Column, area: Column, cfg: EngineConfig = DEFAULT) -> dict[str, Column]:
    """density, coverage and triage_result; a page without area needs OCR."""
    density = F.try_divide(chars, F.nullif(area, F.lit(0.0)) / cfg.density_unit)
    coverage = F.least(F.lit(1.0), F.try_divide(union, F.nullif(area, F.lit(0.0))))
    needs = (coverage >= cfg.image_heavy) | ((density < cfg.sparse_text) & (coverage > cfg.image_some))
    native = (density >= cfg.dense_text) & (coverage <= cfg.image_light)
    return {"density": density, "coverage": coverage, "triage_result": F.when(F.coalesce(area, F.lit(0.0)) <= 0, "ocr_needed").when(needs, "ocr_needed").when(native, "text_native").otherwise("hybrid")}


def triage(pages: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """pages (width, height, text, image_boxes) with density, coverage, triage_result and warnings."""
    w, h = F.coalesce("width", F.lit(0.0)), F.coalesce("height", F.lit(0.0))
    area = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    boxes = F.coalesce("image_boxes", F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))
    on = pages.withColumn("union_area", G.union_area(G.image_boxes(boxes, w, h)))
    found = rule(F.length(X.strip(F.coalesce("text", F.lit("")))), F.col("union_area"), area, cfg)
    bad = F.when(area <= 0, F.array(F.lit("stage0: page has no area"))).otherwise(F.array().cast("array<string>"))
    return on.withColumns({**found, "warnings": bad})


def tally(pages: DataFrame) -> DataFrame:
    return pages.groupBy("triage_result").count()


def info(pages: DataFrame) -> DataFrame:
    """doc_id, page_count and the number of pages of each class: triage and nothing else."""
    each = [F.count_if(F.col("triage_result") == t).alias(t) for t in ("text_native", "ocr_needed", "hybrid")]
    return triage(pages).groupBy("doc_id").agg(F.count("*").alias("page_count"), *each)
