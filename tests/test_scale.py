"""What must not grow faster than the input."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X
from quire.operators import ocr, order, tables, triage
from quire.plans import queries

SF = "/root/testdata/sf0.001"


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def read_by(df, *kinds):
    """Names of the columns that nodes of these kinds read."""
    for node in nodes(df._jdf.queryExecution().optimizedPlan()):
        if node.nodeName() in kinds:
            for i in range(node.children().size()):
                out = node.children().apply(i).output()
                yield from (out.apply(k).name() for k in range(out.size()))


def test_no_characters_are_grouped(spark):
    assert "lines" not in set(read_by(queries.QUERIES["phantom_score"](spark, SF), "Aggregate"))


def test_no_characters_are_joined(spark):
    for name in ("textlayer_pages", "textlayer_blocks", "textlayer_warnings"):
        assert "lines" not in set(read_by(queries.QUERIES[name](spark, SF), "Join", "Aggregate", "Window"))


def test_long_run_of_spaced_capitals(spark):
    """It ended the executor: one call deeper for each letter."""
    t = F.concat(F.repeat(F.lit("A BC\t"), 200_000), F.lit("D Efg"))
    assert spark.range(1).select((X.collapse_spaced(t) == F.concat(F.repeat(F.lit("ABC"), 200_000), F.lit("DEfg"))).alias("x")).first()["x"]


def test_long_words_with_hyphens(spark):
    word = F.repeat(F.lit("w"), 200_000)
    began = time.time()
    got = spark.range(1).select(X.dehyphenate(F.concat(word, F.lit(" a-\n b-\nc "), word, F.lit("-"))).alias("x")).first()["x"]
    assert got == "w" * 200_000 + " ab-\nc " + "w" * 200_000 + "-" and time.time() - began < 10


def test_unions_of_many_boxes(spark):
    """Once for each slab and box, not for each expression that uses the area too; against a plain grid."""
    rng = random.Random(3)
    boxes = [[(rng.randint(0, 60), rng.randint(0, 60), rng.randint(0, 60), rng.randint(0, 60)) for _ in range(n)] for n in (0, 1, 2, 9, 9, 400)]
    kind = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
    df = spark.createDataFrame([(i, [tuple(map(float, b)) for b in own]) for i, own in enumerate(boxes)], f"i int, b {kind}")
    for r in df.select("i", G.union_area(F.col("b")).alias("a")).collect():
        cells = {(x, y) for x0, y0, x1, y1 in boxes[r["i"]] for x in range(min(x0, x1), max(x0, x1)) for y in range(min(y0, y1), max(y0, y1))}
        assert r["a"] == len(cells)
    many = F.transform(F.sequence(F.lit(1), F.lit(2500)), lambda i: G.bbox(i % 500, i % 700, i % 500 + 40, i % 700 + 30 + i % 3))
    page = spark.range(1).select(F.lit("d").alias("doc_id"), F.lit(0).alias("page_num"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), F.lit("").alias("text"), many.alias("image_boxes"))
    began = time.time()
    got = triage.triage(page).where("triage_result = 'ocr_needed'").select("density", "coverage", "union_area", "triage_result").collect()
    assert len(got) == 1 and time.time() - began < 8


def test_gaps_of_long_lines(spark):
    """Built-in expressions took some ten microseconds a letter, twice."""
    rows = spark.range(1).select(F.repeat(F.lit("é漢 a😀  b"), F.col("id").cast("int") + 400_000).alias("t"))
    place = lambda c, i: F.struct(c.alias("ch"), (i * 2.0 + F.floor(i / 9.0) * 7).alias("x"))
    began = time.time()
    parts = rows.select(F.explode(tables.split_on_gaps(F.col("t"), F.lit(0.0), F.lit(10.0), F.transform(F.split("t", ""), place))).alias("p")).groupBy("p.text").count().collect()
    assert sum(len(r["text"]) * r["count"] for r in parts) == 400_000 * 5
    assert time.time() - began < 20


def test_words_of_a_long_line(spark):
    """Every word copied those before it."""
    rows = spark.range(1).select(F.lit("d").alias("doc_id"), F.lit(0).alias("page_num"), F.lit(0).alias("seq"), F.repeat(F.lit("ab c "), F.col("id").cast("int") + 150_000).alias("text"), G.bbox(F.lit(0.0), F.lit(0.0), F.lit(450.0), F.lit(10.0)).alias("bbox"))
    began = time.time()
    got = tables.word_spans(rows).agg(F.count("*").alias("n"), F.max("x1").alias("x1"), F.sum(F.col("x1") - F.col("x0")).alias("w")).first()
    assert got["n"] == 300_000 and got["x1"] == 450.0 and abs(got["w"] - 450) < 1e-6 and time.time() - began < 20


def test_cells_read_words_once(spark):
    plan = queries.QUERIES["cell_assign_range_join"](spark, SF)._jdf.queryExecution().optimizedPlan()
    assert sum(n.nodeName() == "Generate" for n in nodes(plan)) <= 5


def test_mean_confidence_at_a_limit(spark):
    """Pages whose mean is 48 exactly; a hundredth of each mean, added up, came out below."""
    means = [[48.0] * n for n in range(1, 40)] + [[47.9, 48.1] * n for n in range(1, 20)]
    rows = [("d", p, m / 100.0) for p, own in enumerate(means) for m in own]
    blocks = spark.createDataFrame(rows, "doc_id string, page_num int, m double").select("doc_id", "page_num", F.struct(F.col("m").alias("method_score")).alias("confidence"))
    assert {r["mean_conf"] for r in ocr.mean_confidence(blocks).collect()} == {48.0}


def test_paragraphs_are_grouped_once(spark):
    """Not numbered on their page and joined with their own keys."""
    plan = queries.QUERIES["ocr_paragraphs"](spark, SF)._jdf.queryExecution().optimizedPlan()
    kinds = [n.nodeName() for n in nodes(plan)]
    assert kinds.count("Aggregate") == 1 and not {"Join", "Window"} & set(kinds)


def test_cuts_of_many_pages_at_once():
    """As page by page, with boxes missing, in a tenth of the time."""
    rng = np.random.default_rng(7)
    pages = []
    for k in range(400):
        corner = np.floor(rng.uniform(0, 40, (int(rng.integers(0, 40)), 2))) * (14 if k % 2 else 5.3)
        b = np.hstack([corner, corner + np.floor(rng.uniform(0, 8, corner.shape)) * 11])
        b[rng.random(len(b)) < 0.1 * (k % 3)] = np.nan
        pages.append(b)
    rtl = np.arange(len(pages)) % 3 == 0
    starts = np.concatenate(([0], np.cumsum([len(b) for b in pages])))
    got = order.xy_cuts(starts, np.vstack(pages), rtl)
    for k, b in enumerate(pages):
        assert got[starts[k] : starts[k + 1]].tolist() == order.xy_cut(b, bool(rtl[k]))


def test_no_texts_are_joined_for_repeats(spark):
    """Fingerprints are taken before; only blocks in a head or foot are looked up."""
    assert "text" not in set(read_by(queries.QUERIES["promote_blocks"](spark, SF), "Join", "Window"))


def test_words_are_looked_up_cheaply(spark):
    """No pattern for each word and space; only words with a confusion in them are looked up."""
    df = queries.QUERIES["ocr_confusions_dict"](spark, SF)
    assert "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString()
    known = F.array(F.lit("them"), F.lit("d"))
    t = F.lit("(thern, \t ll vvet; cl|||").alias("t")
    assert spark.range(1).select(X.fix_confusions_known(t, known).alias("x")).first()["x"] == "(them, \t ll vvet; cl|||"
