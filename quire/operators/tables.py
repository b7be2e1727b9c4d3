"""Stage 4: ruled tables, tables implied by white space, and the blocks they take in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import DEFAULT, EngineConfig
from quire.functions import arrays
from quire.functions import geometry as G
from quire.functions import text as X
from quire.operators import blocks as B


def ruled_tables(ruled: DataFrame, pages: DataFrame) -> DataFrame:
    """A block for each ruled table with rows; one without a box takes the whole page."""
    on = ruled.where(F.size(F.coalesce("rows", F.array().cast("array<array<string>>"))) > 0).join(pages.select(*B.PAGE, "width", "height"), list(B.PAGE))
    full = G.bbox(F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height"))
    rows = on.withColumns({"seq": F.col("table_no"), "text": X.tsv(F.col("rows")), "bbox": F.coalesce("bbox", full), "block_type": F.lit("table"), "confidence": B.confidence(type_quality=F.lit(0.9))})
    return B.as_blocks(rows, "s4-ruled")


def shape(rows: Column) -> tuple[Column, Column]:
    """Rows and most cells of a row."""
    return F.size(rows), F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))


def word_spans(blocks: DataFrame) -> DataFrame:
    """One row for each word of each line, its width in proportion to its share of the line's letters."""
    own = blocks.where(F.col("bbox").isNotNull() & ~X.blank(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda l: ~X.blank(l))
    rows = own.select(*B.PAGE, "seq", "bbox", F.size(lines).alias("n_lines"), F.posexplode(lines).alias("line", "line_text"))
    found = X.words(F.col("line_text"))
    rows = rows.withColumn("found", found).withColumn("ends", arrays.ends(F.transform("found", lambda w: F.length(w))))
    w = F.col("bbox.x1") - F.col("bbox.x0")
    place = lambda letters: F.col("bbox.x0") + letters / F.col("letters") * w
    high = (F.col("bbox.y1") - F.col("bbox.y0")) / F.col("n_lines")
    y0 = F.col("bbox.y0") + F.col("line") * high
    spans = rows.withColumns({"y0": y0, "y1": y0 + high, "letters": F.get("ends", F.size("ends") - 1)}).select(*B.PAGE, "seq", "line", "y0", "y1", "bbox", "letters", F.posexplode(F.arrays_zip(F.col("found").alias("text"), F.col("ends").alias("end"))).alias("k", "s"))
    spans = spans.select("*", F.col("s.text").alias("text"), place(F.col("s.end") - F.length("s.text")).alias("x0"), place(F.col("s.end")).alias("x1"))
    return spans.select(*B.PAGE, "seq", "line", "k", "text", "x0", "x1", "y0", "y1", ((F.col("y0") + F.col("y1")) / 2).alias("y_center"))


def split_on_gaps(text: Column, x0: Column, x1: Column, positions: Column | None = None, gap: float = DEFAULT.char_gap) -> Column:
    """Parts (text, x0, x1) of a span, cut where a character starts `gap` or more after the last one that is no space."""
    n, w = F.length(text), x1 - x0
    none = F.lit(None).cast("array<struct<ch:string,x:double>>")
    whole = F.array(F.struct(text.alias("text"), x0.cast("double").alias("x0"), x1.cast("double").alias("x1")))
    uncut = F.coalesce(n == 0, F.lit(False)) | F.coalesce(w <= 0, F.lit(False))
    return X.let(arrays.split_on_gaps(text, x0, x1, none if positions is None else positions, gap), lambda parts: F.when(uncut | (F.size(parts) == 0), whole).otherwise(parts))


def row_numbers(ys: Column, gap: float = DEFAULT.row_gap) -> Column:
    """For sorted ys the number of each one's row: a new row where it is more than `gap` off the median of the row so far."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("s"), F.array().cast("array<int>").alias("rows"))

    def step(acc: Column, y: Column) -> Column:
        i, s = acc["i"], acc["s"]
        mid = lambda k: F.get(ys, F.floor((s + i + k) / 2).cast("int"))
        far = (i > s) & (F.abs(y - (mid(-1) + mid(0)) / 2) > gap)
        before = F.coalesce(F.get(acc["rows"], i - 1), F.lit(0))
        return F.struct((i + 1).alias("i"), F.when(far, i).otherwise(s).alias("s"), F.array_append(acc["rows"], F.when(far, before + 1).otherwise(before)).alias("rows"))

    return F.aggregate(ys, start, step, lambda acc: acc["rows"])


def cluster_rows(spans: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """spans with their row number on the page."""
    sorted_ = F.array_sort(F.collect_list(F.struct("y_center", "seq", "line", "k", "text", "x0", "x1", "y0", "y1")))
    packed = spans.groupBy(*B.PAGE).agg(sorted_.alias("s"))
    rows = row_numbers(F.transform("s", lambda s: s["y_center"]), cfg.row_gap)
    return packed.select(*B.PAGE, F.explode(F.arrays_zip("s", rows.alias("row"))).alias("z")).select(*B.PAGE, "z.row", "z.s.*")


def columns(spans: DataFrame, pages: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """doc_id, page_num, col, x0 and x1 of each column: groups of starts, from the median of one to the next."""
    width = F.coalesce(F.nullif("width", F.lit(0.0)), F.lit(cfg.default_page_width))
    on = spans.join(pages.select(*B.PAGE, F.greatest(width * cfg.column_gap_share, F.lit(cfg.column_gap_least)).alias("gap")), list(B.PAGE))
    w = Window.partitionBy(*B.PAGE).orderBy("x0")
    flagged = on.withColumn("new", F.when(F.col("x0") - F.lag("x0").over(w) > F.col("gap"), 1).otherwise(0)).withColumn("col", F.sum("new").over(w).cast("int"))
    starts = flagged.groupBy(*B.PAGE, "col").agg(F.median("x0").alias("x0"), F.max("x1").alias("far"))
    page = Window.partitionBy(*B.PAGE)
    nxt = F.lead("x0").over(page.orderBy("col"))
    out = starts.withColumns({"x1": F.coalesce(nxt - 1.0, F.max("far").over(page)), "n": F.count("*").over(page)})
    return out.where(F.col("n") >= cfg.min_columns).select(*B.PAGE, "col", "x0", "x1")


def cells(rows: DataFrame, cols: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Text of each row and column: the words that lie in the column's range, left to right; a word may fit several or none.

    Words are shuffled once, by page, and packed by row; a row then meets the columns of its page.
    """
    c = cols.groupBy(*B.PAGE).agg(F.collect_list(F.struct("col", F.col("x0").alias("c0"), F.col("x1").alias("c1"))).alias("cols"))
    packed = rows.repartition(*(F.col(k) for k in B.PAGE)).groupBy(*B.PAGE, "row").agg(F.array_sort(F.collect_list(F.struct("x0", "y_center", "seq", "line", "k", "text", "x1"))).alias("words"))
    grid = packed.join(c, list(B.PAGE)).select(*B.PAGE, "row", "words", F.inline("cols"))
    fit = F.filter("words", lambda w: (w["x0"] >= F.col("c0") - cfg.cell_pad) & (w["x1"] <= F.col("c1") + cfg.cell_pad))
    return grid.select(*B.PAGE, "row", "col", X.strip(F.array_join(F.transform(fit, lambda w: w["text"]), " ")).alias("text"))


def implicit_tables(pages: DataFrame, blocks: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """At most one table for each page: rows and columns of aligned words."""
    raw = word_spans(blocks.where(F.col("block_type").isin("body", "table")))
    parts = raw.select(*B.PAGE, "seq", "line", "k", "y0", "y1", "y_center", F.posexplode(split_on_gaps(F.col("text"), F.col("x0"), F.col("x1"), None, cfg.char_gap if cfg.compat else 1e9)).alias("part", "p"))
    spans = parts.select(*B.PAGE, "seq", "line", (F.col("k").cast("long") * (1 << 32) + F.col("part")).alias("k"), "p.text", "p.x0", "p.x1", "y0", "y1", "y_center")
    rows = cluster_rows(spans, cfg)
    many = rows.groupBy(*B.PAGE).agg(F.countDistinct("row").alias("n"), G.bbox(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).alias("bbox")).where(F.col("n") >= cfg.min_rows)
    text = cells(rows, columns(rows, pages, cfg), cfg).groupBy(*B.PAGE, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]), "\t").alias("line"))
    whole = text.groupBy(*B.PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]), "\n").alias("text"))
    made = many.join(whole, list(B.PAGE)).withColumns({"seq": F.lit(0), "block_type": F.lit("table"), "extraction_method": F.lit("surya_layout"), "confidence": B.confidence(type_quality=F.lit(0.6), method_score=F.lit(0.8))})
    return B.as_blocks(made, "s4-implicit")


def _covered(rows: DataFrame, tables: DataFrame, share: float) -> DataFrame:
    """Rows that a table of the same page covers by more than `share`."""
    t = tables.select(*B.PAGE, F.col("bbox").alias("t_box"))
    return rows.join(t, list(B.PAGE)).where(G.overlap_share(F.col("bbox"), F.col("t_box")) > share).select("doc_id", "block_id").distinct()


def drop_dominated(implicit: DataFrame, explicit: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    return implicit.where("bbox IS NOT NULL").join(_covered(implicit, explicit, cfg.table_overlap), ["doc_id", "block_id"], "left_anti").select(*B.COLUMNS)


def absorb(blocks: DataFrame, tables: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """blocks without those other than tables that a table covers by more than half."""
    other = blocks.where("block_type <> 'table'")
    return blocks.join(_covered(other, tables, cfg.table_overlap), ["doc_id", "block_id"], "left_anti").select(*B.COLUMNS)


def run(pages: DataFrame, blocks: DataFrame, ruled: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Pages with tables are sorted again, top to bottom; others keep their order."""
    explicit = ruled_tables(ruled, pages)
    tables = explicit.unionByName(drop_dominated(implicit_tables(pages, blocks, cfg), explicit, cfg))
    both = absorb(blocks, tables, cfg).withColumn("__t", F.lit(0)).unionByName(tables.withColumn("__t", F.lit(1)))
    has = F.max("__t").over(Window.partitionBy(*B.PAGE)) == 1
    both = both.withColumn("__has", has)
    key = lambda c: F.when(F.col("__has"), F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0)
    return B.renumber(both, key("bbox.y0"), key("bbox.x0"), F.col("__t"), F.col("seq"), F.col("block_id")).select(*B.COLUMNS)
