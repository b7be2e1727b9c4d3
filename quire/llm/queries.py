"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chat, chunks, decontaminate, jaccard, langid, packing, ppm, quality, toxic, webp, webp_write
from quire.llm.common import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Words are letters, digits and marks, without accents and case; runs of 8, or whole items of 4 to 7 words.
OP1_SQL = r"""
WITH src AS (SELECT 0 AS kind, row_number() OVER () AS r, doc_id AS id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), item_id, text FROM benchmark),
pc AS (SELECT kind, r, id, unnest(regexp_extract_all(text, '[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+')) AS x, generate_subscripts(regexp_extract_all(text, '[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+'), 1) AS i FROM src WHERE text IS NOT NULL),
ps AS (SELECT *, sum(length(x)) OVER (PARTITION BY kind, r ORDER BY i) - length(x) AS s FROM pc),
w AS (SELECT kind, r, id, s, s + length(x) AS e, replace(strip_accents(lower(x)), 'ß', 'ss') AS x, row_number() OVER (PARTITION BY kind, r ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY kind, r) AS n FROM ps WHERE regexp_matches(x, '^[\p{L}\p{N}\p{M}]')),
z AS (SELECT DISTINCT CASE WHEN n >= 8 THEN 8 ELSE n END AS size FROM w WHERE kind = 1 AND n >= 4),
l AS (SELECT kind, r, id, n, list(x ORDER BY k) AS xs, list(s ORDER BY k) AS ss, list(e ORDER BY k) AS es FROM w GROUP BY ALL),
g AS (SELECT kind, r, id, n, size, unnest(range(n - size + 1)) AS k, ss, es, xs FROM l, z WHERE n >= size AND (kind = 0 OR size = least(8, n))),
h AS (SELECT *, array_to_string(xs[k + 1 : k + size], ' ') AS t FROM g),
m AS (SELECT d.r AS dr, d.id AS doc_id, b.r AS br, b.id AS item_id, b.n AS total, d.k AS p, b.k AS i, b.size, d.ss, d.es FROM h d JOIN h b ON d.t = b.t AND d.size = b.size WHERE d.kind = 0 AND b.kind = 1),
c AS (SELECT *, CASE WHEN p > max(p + size) OVER (PARTITION BY dr, br ORDER BY p, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw FROM m),
o AS (SELECT *, sum(nw) OVER (PARTITION BY dr, br ORDER BY p, i) AS run FROM c),
q AS (SELECT dr, br, run, any_value(doc_id) AS doc_id, any_value(item_id) AS item_id, any_value(total) AS total, min(p) AS a, max(p + size) AS b, any_value(ss) AS ss, any_value(es) AS es, len(list_distinct(flatten(list(range(i, i + size))))) AS seen FROM o GROUP BY 1, 2, 3)
SELECT doc_id, item_id, ss[a + 1]::INTEGER AS start, es[b]::INTEGER AS "end", (b - a)::INTEGER AS n_words, seen / total AS item_share FROM q
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_windows(table(spark, sf_dir, "documents"), tokenizer=TOKENIZER)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ppm.score(docs, ppm.fit(docs))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
t AS (SELECT doc_id, string_agg(g, '|' ORDER BY g) AS grams FROM g GROUP BY doc_id),
m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY grams) AS rep, count(*) OVER (PARTITION BY grams) - 1 AS copies FROM t),
h AS (SELECT g.* FROM g JOIN m ON m.doc_id = g.doc_id AND m.rep = m.doc_id),
s AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b WHERE p.n / (x.n + y.n - p.n) >= 0.65),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS rep, min(b) AS class_id FROM r GROUP BY 1),
k AS (SELECT a AS rep, count(*) AS links FROM e GROUP BY 1)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(k.links, 0) AS links, coalesce(m.copies, 0) AS copies
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d
LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN c ON c.rep = m.rep LEFT JOIN k ON k.rep = m.rep
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunks.dedup(docs, spans_col="spans")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic.tag_documents(docs, toxic.fit(docs, table(spark, sf_dir, "labels")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no rejected replies: chat.worsened() makes them. Masks are written as "start-end" lists, for the comparison with SQL."""
    pairs = chat.format_pairs(chat.worsened(table(spark, sf_dir, "conversations")))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",").alias(c)
    return pairs.select(F.col("id").alias("conv_id"), "prompt", "chosen", "rejected", told("chosen_mask"), told("rejected_mask"))


OP9_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS k FROM t),
l AS (SELECT *, max(CASE WHEN role = 'assistant' THEN k END) OVER (PARTITION BY conv_id) AS last FROM o),
p AS (SELECT *, max(CASE WHEN role = 'assistant' AND k < last THEN k END) OVER (PARTITION BY conv_id) AS prior FROM l WHERE k <= last),
e AS (SELECT *, max(CASE WHEN k = last THEN text END) OVER (PARTITION BY conv_id) AS lt, max(CASE WHEN k = prior THEN text END) OVER (PARTITION BY conv_id) AS pt FROM p),
b AS (
  SELECT conv_id, k, role, text AS c,
    CASE WHEN k = last AND prior IS NULL THEN substr(lt, 1, length(lt) // 2) WHEN k = last THEN pt WHEN k = prior THEN lt ELSE text END AS r
  FROM e),
d AS (SELECT *, min(CASE WHEN c IS DISTINCT FROM r THEN k END) OVER (PARTITION BY conv_id) AS f FROM b),
h AS (
  SELECT conv_id, k, f, role, '<|' || translate(replace(replace(coalesce(role, ''), '<|', '< |'), '|>', '| >'), chr(10) || chr(13), '  ') || '|>' || chr(10) AS h,
    replace(coalesce(c, ''), '<|', '< |') || '<|end|>' || chr(10) AS c, replace(coalesce(r, ''), '<|', '< |') || '<|end|>' || chr(10) AS r
  FROM d WHERE f IS NOT NULL),
s AS (
  SELECT *, sum(CASE WHEN k >= f THEN length(h) + length(c) ELSE 0 END) OVER w AS ce, sum(CASE WHEN k >= f THEN length(h) + length(r) ELSE 0 END) OVER w AS re
  FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY k))
SELECT conv_id,
  coalesce(string_agg(h || c, '' ORDER BY k) FILTER (WHERE k < f), '') AS prompt,
  string_agg(h || c, '' ORDER BY k) FILTER (WHERE k >= f) AS chosen,
  string_agg(h || r, '' ORDER BY k) FILTER (WHERE k >= f) AS rejected,
  coalesce(string_agg((ce - length(c))::BIGINT || '-' || ce::BIGINT, ',' ORDER BY k) FILTER (WHERE k >= f AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((re - length(r))::BIGINT || '-' || re::BIGINT, ',' ORDER BY k) FILTER (WHERE k >= f AND role = 'assistant'), '') AS rejected_mask
FROM s GROUP BY conv_id
"""


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images, so all bytes of each page are written as the pixels of one first; the query decodes all of them. Pixels are hex, for the comparison with SQL."""
    found = webp.decode_images(webp_write.picture_files(table(spark, sf_dir, "pages")))
    return found.select("image_id", "width", "height", F.hex("pixels").alias("pixels"), F.coalesce("error", F.lit("")).alias("error"))


OP10_SQL = r"""
WITH p AS (SELECT page_id, hex(encode(html)) AS x, CASE WHEN coalesce(page_id, 0) % 6 IN (1, 4) THEN 1 ELSE 3 END AS k FROM pages),
n AS (SELECT *, greatest(1, ceil(length(x) / 2 / k))::BIGINT AS n FROM p),
w AS (SELECT *, ceil(sqrt(n))::BIGINT AS w FROM n),
h AS (SELECT *, ceil(n / w)::BIGINT AS h FROM w)
SELECT page_id AS image_id, CASE WHEN x IS NOT NULL THEN w END::INTEGER AS width, CASE WHEN x IS NOT NULL THEN h END::INTEGER AS height,
  CASE WHEN k = 1 THEN regexp_replace(rpad(x, (2 * w * h)::INTEGER, '0'), '(..)', '\1\1\1FF', 'g') ELSE regexp_replace(rpad(x, (6 * w * h)::INTEGER, '0'), '(......)', '\1FF', 'g') END AS pixels,
  '' AS error
FROM h
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_language_id, op3_packing, op4_lm_score, op5_jaccard_join, op6_quality, op7_substring_dedup, op8_toxicity, op9_chat_format, op10_media)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op5_jaccard_join": OP5_SQL, "op9_chat_format": OP9_SQL, "op10_media": OP10_SQL}
