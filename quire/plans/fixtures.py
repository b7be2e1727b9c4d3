"""Engine tables derived from the test tables, as DataFrames and as the same SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block for each line that is not blank: a document is a source, a page one of its texts."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL")
    rows = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page_num"), F.posexplode(F.split("text", "\n")).alias("seq", "text")).where(F.trim("text") != "")
    two = F.when(F.col("seq") % 2 == 0, 72.0).otherwise(320.0)
    y = F.lit(40.0) + F.col("seq") * 16.0
    method = F.element_at(F.array(*[F.lit(m) for m in ("pymupdf_direct", "surya_layout", "surya_ocr", "tesseract_ocr")]), F.col("page_num") % 4 + 1)
    kind = F.when(F.length("text") <= 60, "heading").otherwise("body")
    rows = rows.withColumns({"n": F.length("text"), "x0": two, "y0": y, "extraction_method": method, "block_type": kind})
    return rows.withColumns({"x1": F.col("x0") + F.least(F.col("n") * 5.0, F.lit(200.0)), "y1": F.col("y0") + 12.0, "block_id": F.concat_ws("-", F.col("page_num").cast("string"), F.col("seq").cast("string"))}).withColumn("bbox", G.bbox(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


LINES = r"""
raw_l AS (SELECT source AS doc_id, doc_id::INTEGER AS page_num, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS seq, unnest(string_split(text, chr(10))) AS text
  FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
l0 AS (SELECT *, length(text)::INTEGER AS n, CASE WHEN seq % 2 = 0 THEN 72.0::DOUBLE ELSE 320.0::DOUBLE END AS x0, 40.0::DOUBLE + seq * 16.0::DOUBLE AS y0,
    ['pymupdf_direct', 'surya_layout', 'surya_ocr', 'tesseract_ocr'][page_num % 4 + 1] AS extraction_method, CASE WHEN length(text) <= 60 THEN 'heading' ELSE 'body' END AS block_type,
    page_num || '-' || seq AS block_id
  FROM raw_l WHERE trim(text) <> ''),
l AS (SELECT *, x0 + least(n * 5.0::DOUBLE, 200.0::DOUBLE) AS x1, y0 + 12.0::DOUBLE AS y1 FROM l0)
"""


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order, an image for each of its items, and some text."""
    items = table(spark, sf_dir, "lineitem")
    x, y = (F.col("l_partkey") * 7) % 300, (F.col("l_suppkey") * 11) % 400
    box = G.bbox(x, y, x + 20 + F.col("l_partkey") % 275, y + 20 + F.col("l_quantity").cast("int") * 8)
    by = items.groupBy(F.col("l_orderkey").alias("key")).agg(F.collect_list(box).alias("boxes"))
    plain = F.col("key") % 5 == 0
    n = F.when(plain, (F.col("key") * 37) % 900).when(F.col("key") % 3 == 0, 0).otherwise((F.col("key") * 37) % 900).cast("int")
    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    return by.select("key", (F.col("key") % 50).cast("string").alias("doc_id"), F.col("key").cast("int").alias("page_num"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), F.repeat(F.lit("x"), n).alias("text"), F.when(plain, none).otherwise(F.col("boxes")).alias("image_boxes"))


BOXES = r"""
bx AS (SELECT l_orderkey AS key, ((l_partkey * 7) % 300)::DOUBLE AS x0, ((l_suppkey * 11) % 400)::DOUBLE AS y0,
    ((l_partkey * 7) % 300 + 20 + l_partkey % 275)::DOUBLE AS x1, ((l_suppkey * 11) % 400 + 20 + trunc(l_quantity)::BIGINT * 8)::DOUBLE AS y1 FROM lineitem),
cl AS (SELECT key, x0, y0, least(x1, 595.0::DOUBLE) AS x1, least(y1, 842.0::DOUBLE) AS y1 FROM bx WHERE key % 5 <> 0),
ys AS (SELECT DISTINCT key, y FROM (SELECT key, y0 AS y FROM cl UNION ALL SELECT key, y1 FROM cl)),
sl AS (SELECT key, y AS a, lead(y) OVER (PARTITION BY key ORDER BY y) AS b FROM ys),
iv AS (SELECT s.key, s.a, s.b, c.x0, c.x1, max(c.x1) OVER (PARTITION BY s.key, s.a ORDER BY c.x0, c.x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM sl s JOIN cl c ON s.key = c.key AND c.y0 <= s.a AND c.y1 >= s.b WHERE s.b IS NOT NULL),
ua AS (SELECT key, sum((b - a) * greatest(0.0::DOUBLE, x1 - greatest(x0, coalesce(reach, -1e300)))) AS area FROM iv GROUP BY key),
pg AS (SELECT k.key, coalesce(ua.area, 0.0::DOUBLE) AS area, CASE WHEN k.key % 5 = 0 THEN (k.key * 37) % 900 WHEN k.key % 3 = 0 THEN 0 ELSE (k.key * 37) % 900 END AS chars
  FROM (SELECT DISTINCT key FROM bx) k LEFT JOIN ua ON ua.key = k.key),
tr AS (SELECT *, chars / (595.0 * 842.0 / 10000.0) AS density, least(1.0::DOUBLE, area / (595.0 * 842.0)) AS cov FROM pg),
tri AS (SELECT *, CASE WHEN cov >= 0.8 OR (density < 5 AND cov > 0.1) THEN 'ocr_needed' WHEN density >= 10 AND cov <= 0.2 THEN 'text_native' ELSE 'hybrid' END AS triage_result FROM tr)
"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region for every 4 lines of a page, around them."""
    g = F.floor(F.col("seq") / 4).cast("int")
    label = F.element_at(F.array(*[F.lit(x) for x in ("Text", "Title", "Table", "Figure", "Caption", "Page-header", "Footnote", "Other")]), F.col("region_seq") % 8 + 1)
    by = lines(spark, sf_dir).groupBy("doc_id", "page_num", g.alias("region_seq")).agg(G.bbox(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).alias("bbox"))
    return by.withColumns({"label": label, "confidence": (30 + (F.col("page_num") * 7 + F.col("region_seq")) % 70) / 100.0})


REGIONS = r"""
rg AS (SELECT doc_id, page_num, (seq // 4)::INTEGER AS region_seq, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
    ['Text', 'Title', 'Table', 'Figure', 'Caption', 'Page-header', 'Footnote', 'Other'][(seq // 4) % 8 + 1] AS label, (30 + (page_num * 7 + seq // 4) % 70) / 100.0::DOUBLE AS confidence
  FROM l GROUP BY doc_id, page_num, seq // 4)
"""


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word of an OCR table for each word of each text."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL")
    rows = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page_num"), F.posexplode(F.split("text", "[ \n]")).alias("i", "text"))
    return rows.withColumns({
        "conf": ((F.col("page_num") * 13 + F.col("i")) % 101 - 5).cast("double"), "left": ((F.col("i") % 10) * 50).cast("int"), "top": (F.floor(F.col("i") / 10) * 14).cast("int"),
        "width": F.length("text") * 5, "height": F.lit(10), "block_num": F.floor(F.col("i") / 40).cast("int"), "par_num": F.floor(F.col("i") / 20).cast("int"),
    })


WORDS = r"""
ow AS (SELECT doc_id, page_num, i, text, ((page_num * 13 + i) % 101 - 5)::DOUBLE AS conf, (i % 10) * 50 AS lft, (i // 10) * 14 AS top, length(text) * 5 AS width, 10 AS height, (i // 40)::INTEGER AS block_num, (i // 20)::INTEGER AS par_num
  FROM (SELECT source AS doc_id, doc_id::INTEGER AS page_num, unnest(range(len(string_split_regex(text, '[ \n]')))) AS i, unnest(string_split_regex(text, '[ \n]')) AS text
    FROM documents WHERE text IS NOT NULL AND source IS NOT NULL))
"""
