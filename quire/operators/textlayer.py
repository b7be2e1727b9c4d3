"""Stage 1: text blocks from raw character layers, and whether a layer is a phantom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import DEFAULT, EngineConfig
from quire.functions import text as X
from quire.operators import blocks as B


def span_chars(lines: Column) -> Column:
    """Every character of a block with its font and size."""
    spans = F.flatten(F.transform(lines, lambda l: l["spans"]))
    return F.flatten(F.transform(spans, lambda s: F.transform(s["chars"], lambda c: F.struct(c["c"].alias("c"), (c["bbox"]["x1"] - c["bbox"]["x0"]).alias("w"), s["size"].alias("size"), F.lower(s["font"]).alias("font")))))


def char_counts(lines: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """(n, tight, hidden) of a block: its characters, those without width and those that can't be seen. Fonts are looked at once a span."""

    def tell(s: Column) -> Column:
        n = F.array_size(s["chars"])
        unseen = F.coalesce(s["size"] < cfg.tiny_font, F.lit(False)) | F.coalesce(F.lower(s["font"]).rlike("glyphless|invisible"), F.lit(False))
        tight = F.filter(F.zip_with(s["chars"]["bbox"]["x1"], s["chars"]["bbox"]["x0"], lambda a, b: a - b), lambda w: w < cfg.zero_width)
        return X.let(tight, lambda t: F.struct(n.alias("n"), F.array_size(t).alias("tight"), F.when(unseen, n).otherwise(F.array_size(F.filter(t, lambda w: w > -cfg.zero_width))).alias("hidden")))

    spans = F.transform(F.flatten(lines["spans"]), tell)
    start = F.struct(*(F.lit(0).alias(c) for c in ("n", "tight", "hidden")))
    return F.aggregate(spans, start, lambda acc, s: F.struct(*((acc[c] + s[c]).alias(c) for c in ("n", "tight", "hidden"))))


def measured(raw: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The text blocks of raw with their text and counts (k) in place of their characters, which take a hundred times the room: all that is shuffled or sorted later."""
    return raw.where("type = 0").withColumns({"text": block_text(F.col("lines")), "k": char_counts(F.col("lines"), cfg)}).drop("lines")


def _share(chars: Column, hit) -> Column:
    return F.try_divide(F.size(F.filter(chars, hit)), F.nullif(F.size(chars), F.lit(0)))


def _hidden(c: Column, cfg: EngineConfig) -> Column:
    return (F.abs(c["w"]) < cfg.zero_width) | (c["size"] < cfg.tiny_font) | F.coalesce(c["font"].rlike("glyphless|invisible"), F.lit(False))


def zero_width_score(chars: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """One less the share of characters without width; 1 without characters."""
    return 1.0 - F.coalesce(_share(chars, lambda c: c["w"] < cfg.zero_width), F.lit(0.0))


def invisible_share(chars: Column, cfg: EngineConfig = DEFAULT) -> Column:
    return F.coalesce(_share(chars, lambda c: _hidden(c, cfg)), F.lit(0.0))


def phantom_score(s1: Column, invisible: Column, s3: Column, s4: Column | None = None, cfg: EngineConfig = DEFAULT) -> Column:
    """Weighted signals; the sampled OCR comparison counts only where the others leave it open."""
    base = 0.35 * s1 + 0.30 * (1.0 - invisible) + 0.20 * s3
    open_ = base.between(cfg.ambiguous_low, cfg.ambiguous_high)
    score = base / 0.85 if s4 is None else F.when(open_ & s4.isNotNull(), base + 0.15 * s4).otherwise(base / 0.85)
    score = F.when(invisible > cfg.invisible_cap, F.least(score, 1.0 - invisible)).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def score_pages(raw: DataFrame, samples: DataFrame | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """doc_id, page_num, zero_width, invisible, quality and phantom_score; samples: (doc_id, page_num, s4)."""
    return _scored(measured(raw, cfg), samples, cfg).drop("b")


def _scored(layer: DataFrame, samples: DataFrame | None, cfg: EngineConfig) -> DataFrame:
    """The scores of each page of measured blocks, and the blocks (b)."""
    rest = [c for c in layer.columns if c not in (*B.PAGE, "k")]
    whole = F.array_join(F.transform(F.array_sort(F.transform("b", lambda b: F.struct(b["block_no"].alias("block_no"), b["text"].alias("t")))), lambda b: b["t"]), "\n")
    by = layer.groupBy(*B.PAGE).agg(*(F.sum(F.col(f"k.{c}")).alias(c) for c in ("n", "tight", "hidden")), F.collect_list(F.struct(*rest)).alias("b")).withColumn("text", whole)
    out = by.withColumns({"zero_width": 1.0 - F.coalesce(F.try_divide("tight", F.nullif("n", F.lit(0))), F.lit(0.0)), "invisible": F.coalesce(F.try_divide("hidden", F.nullif("n", F.lit(0))), F.lit(0.0)), "quality": X.quality(F.col("text"), F.lit(None).cast("string"))})
    if samples is not None:
        out = out.join(samples, list(B.PAGE), "left")
    score = phantom_score(F.col("zero_width"), F.col("invisible"), F.col("quality"), F.col("s4") if samples is not None else None, cfg)
    return out.select(*B.PAGE, "zero_width", "invisible", "quality", score.alias("phantom_score"), "b")


def block_text(lines: Column) -> Column:
    """Characters of each line together, lines that are not empty joined by line ends."""
    line = lambda l: F.array_join(F.flatten(F.transform(l["spans"], lambda s: s["chars"]["c"])), "")
    return F.array_join(F.filter(F.transform(lines, line), lambda t: t != ""), "\n")


def extract(pages: DataFrame, raw: DataFrame, samples: DataFrame | None = None, cfg: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, blocks, warnings) of the pages that have a usable text layer."""
    open_ = pages.where(F.col("triage_result").isin("text_native", "hybrid"))
    layer = _scored(measured(raw, cfg).join(open_.select(*B.PAGE), list(B.PAGE), "left_semi"), samples, cfg)
    scored = pages.join(layer.drop("b"), list(B.PAGE), "left")
    phantom = F.coalesce(F.col("phantom_score") < cfg.phantom_below, F.lit(False)) & (F.col("triage_result") != "ocr_needed")
    pages_out = scored.withColumn("triage_result", F.when(phantom & (F.col("triage_result") == "text_native"), "hybrid").otherwise(F.col("triage_result")))
    said = scored.where(phantom).select(*B.PAGE, F.format_string("stage1: phantom text layer suspected (score=%.2f)", "phantom_score").alias("a"), F.when(F.col("triage_result") == "text_native", "stage1: text_native downgraded to hybrid").alias("b"))
    told = B.warnings(said.select(*B.PAGE, F.posexplode(F.array("a", "b")).alias("seq", "m")).where("m IS NOT NULL"), 1, F.col("m"))
    method = layer.select(*B.PAGE, "phantom_score", F.inline("b")).withColumn("text", X.strip(F.col("text"))).where(F.length("text") >= cfg.min_block_chars)
    blocks = method.withColumn("seq", F.col("block_no")).withColumns({"script_direction": X.direction(F.col("text")), "confidence": B.confidence(text_quality=X.quality(F.col("text"), F.lit(None).cast("string")), method_score=F.col("phantom_score"))})
    return pages_out, B.as_blocks(blocks, "s1"), told
