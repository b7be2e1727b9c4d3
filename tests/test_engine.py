"""Golden values of the extraction stages, on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire import cli
from quire.config import DEFAULT
from quire.functions import geometry as G
from quire.functions import text as X
from quire.operators import assembly, crosspage, layout, ocr, order, post, score, tables, textlayer, triage
from quire.operators import blocks as B
from quire.plans import pipeline, queries
from quire.sources import decode, sinks

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def one(spark, column, **values):
    types = {k: v[1] for k, v in values.items()}
    df = spark.createDataFrame([tuple(v[0] for v in values.values())], ", ".join(f"{k} {t}" for k, t in types.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def texts(spark, fn, *given):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("i", fn(F.col("t")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


def blocks(spark, rows, **columns):
    """rows: (doc, page, seq, text, box or None, type)."""
    df = spark.createDataFrame(rows, f"doc_id string, page_num int, seq int, text string, bbox {BOX}, block_type string")
    return B.as_blocks(df.withColumns(columns) if columns else df, "test")


def pages(spark, n=1, w=595.0, h=842.0, doc="d"):
    return spark.createDataFrame([(doc, p, w, h, "", []) for p in range(n)], f"doc_id string, page_num int, width double, height double, text string, image_boxes array<{BOX}>")


def test_union_area(spark):
    cases = [([], 0), ([(0, 0, 10, 10)], 100), ([(0, 0, 10, 10), (20, 0, 30, 10)], 200), ([(0, 0, 10, 10)] * 2, 100), ([(0, 0, 10, 10), (5, 0, 15, 10)], 150), ([(10, 10, 0, 0)], 100)]
    df = spark.createDataFrame([(i, [tuple(map(float, b)) for b in c]) for i, (c, _) in enumerate(cases)], f"i int, b array<{BOX}>")
    assert [r["a"] for r in df.select("i", G.union_area(F.col("b")).alias("a")).orderBy("i").collect()] == [float(a) for _, a in cases]


def test_triage_classes(spark):
    full, box = (0.0, 0.0, 595.0, 842.0), f"array<{BOX}>"
    rows = [(0, "x" * 600, []), (1, "", [full]), (2, "x" * 600, [full, full]), (3, "x" * 1080, [(0.0, 0.0, 495.0, 842 * 0.4)]), (4, "", [])]
    df = spark.createDataFrame([("d", i, 595.0, 842.0, t, b) for i, t, b in rows], f"doc_id string, page_num int, width double, height double, text string, image_boxes {box}")
    got = [r["triage_result"] for r in triage.triage(df).orderBy("page_num").collect()]
    assert got == ["text_native", "ocr_needed", "ocr_needed", "hybrid", "hybrid"]
    assert triage.triage(df.withColumn("width", F.lit(0.0))).where("triage_result = 'ocr_needed' AND size(warnings) = 1").count() == 5
    assert triage.info(df).first().asDict() == {"doc_id": "d", "page_count": 5, "text_native": 1, "ocr_needed": 2, "hybrid": 2}


def test_quality_and_direction(spark):
    none = F.lit(None).cast("string")
    en, zh, ar, bad, empty, space = texts(spark, lambda t: X.quality(t, none), "This is a plain English sentence with several words in it.", "这是一个普通的中文句子没有空格", "هذه جملة عربية عادية فيها عدة كلمات", "�" * 50 + "text", "", "     ")
    assert en >= 0.85 and zh >= 0.75 and ar >= 0.70 and bad < 0.6 and empty == 0 and space < 0.5
    assert texts(spark, X.direction, "مرحبا بالعالم", "שלום עולם", "", "Hello " * 10 + "مرحبا", "Hello") == ["rtl", "rtl", "ltr", "ltr", "ltr"]
    df = spark.createDataFrame([("zh", ""), ("ja-JP", ""), ("ar", ""), ("th", ""), ("en", "汉字汉字"), (None, "汉字汉字")], "l string, t string")
    assert [r["f"] for r in df.select(X.script_family(F.col("l"), F.col("t")).alias("f")).collect()] == ["cjk", "cjk", "arabic", "thai", "default", "cjk"]


def test_jaccard(spark):
    df = spark.createDataFrame([("a b", "A B"), ("a b", "c d"), ("", ""), ("a", ""), ("a b c", "b c d")], "a string, b string")
    got = [r["j"] for r in df.select(X.jaccard(F.col("a"), F.col("b")).alias("j")).collect()]
    assert got[:4] == [1, 0, 1, 0] and 0.3 < got[4] < 0.8


def raw(spark, chars, font="Helv", size=10.0):
    cells = [(c, (i * 5.0, 0.0, i * 5.0 + w, 10.0)) for i, (c, w) in enumerate(chars)]
    schema = f"doc_id string, page_num int, block_no int, type int, bbox {BOX}, lines array<struct<spans:array<struct<font:string,size:double,chars:array<struct<c:string,bbox:{BOX}>>>>>>"
    return spark.createDataFrame([("d", 0, 0, 0, (0.0, 0.0, 100.0, 10.0), [([(font, size, cells)],)])], schema)


def test_phantom_layers(spark):
    good = [(c, 5.0) for c in "This is a visible text layer with words"]
    assert textlayer.score_pages(raw(spark, good)).first()["phantom_score"] >= 0.85
    for r in (raw(spark, good, font="GlyphLessFont"), raw(spark, [(c, 0.0) for c, _ in good])):
        assert textlayer.score_pages(r).first()["phantom_score"] <= 0.10
    half = textlayer.score_pages(raw(spark, [(c, 5.0 * (i % 2)) for i, (c, _) in enumerate(good + [("x", 5.0)])])).first()
    assert half["zero_width"] == 0.5
    p = pages(spark).withColumn("triage_result", F.lit("text_native"))
    out, found, said = textlayer.extract(p, raw(spark, good, font="invisible"))
    assert out.first()["triage_result"] == "hybrid" and said.count() == 2 and found.count() == 1
    assert textlayer.extract(p.withColumn("triage_result", F.lit("ocr_needed")), raw(spark, good))[1].count() == 0


def test_captions_and_regions(spark):
    rows = [("d", 0, 0, "", (100.0, 100.0, 300.0, 300.0), "figure"), ("d", 0, 1, "", (90.0, 90.0, 400.0, 400.0), "figure"), ("d", 0, 2, "near", (96.0, 150.0, 200.0, 160.0), "caption"), ("d", 0, 3, "far", (80.0, 150.0, 84.0, 160.0), "caption")]
    got = {r["text"]: r["parent_id"] for r in layout.link_captions(blocks(spark, rows)).collect()}
    small = blocks(spark, rows).where("seq = 0").first()["block_id"]
    assert got["near"] == small and got["far"] is None
    region = spark.createDataFrame([("d", 0, 0, (0.0, 0.0, 1190.0, 842.0), "Text", 0.9), ("d", 0, 1, (0.0, 0.0, 10.0, 10.0), "Text", 0.1)], f"doc_id string, page_num int, region_seq int, bbox {BOX}, label string, confidence double")
    fitted = layout.fit_regions(region, pages(spark)).collect()
    assert len(fitted) == 1 and fitted[0]["bbox"]["x1"] == 595.0 and fitted[0]["bbox"]["y1"] == 421.0
    made, said = layout.run(pages(spark), blocks(spark, []), region.where("false"))
    assert made.count() == 1 and said.count() == 1 and made.first()["confidence"]["type_quality"] == 0.3


def test_reading_order(spark):
    left, right = [(50.0, y, 250.0, y + 95) for y in (100.0, 200.0, 300.0)], [(320.0, y, 520.0, y + 95) for y in (150.0, 250.0, 350.0)]
    boxes = np.array([right[0], left[0], left[1], right[1], right[2], left[2]])
    assert order.xy_cut(boxes, False) == [1, 2, 5, 0, 3, 4]
    assert order.xy_cut(boxes, True) == [0, 3, 4, 1, 2, 5]
    titled = np.vstack([boxes, [(50.0, 20.0, 520.0, 60.0)]])
    assert order.xy_cut(titled, False)[0] == 6
    rng = np.random.default_rng(0)
    for _ in range(50):
        b = rng.uniform(0, 500, (20, 2))
        b = np.hstack([b, b + rng.uniform(1, 100, (20, 2))])
        assert sorted(order.xy_cut(b, False)) == list(range(20))
    df = spark.createDataFrame([(0.0, 100.0, 80.0), (0.0, 100.0, 50.0), (None, None, 5.0), (60.0, 60.0, 60.0)], "lo double, hi double, cut double")
    assert [r["s"] for r in df.select(order.cut_side(F.col("lo"), F.col("hi"), F.col("cut")).alias("s")).collect()] == ["before", "before", "before", "before"]
    rows = [("d", 0, i, str(i), tuple(map(float, b)), "body") for i, b in enumerate(boxes)]
    _, done = order.run(pages(spark), blocks(spark, rows))
    assert [r["text"] for r in done.orderBy("seq").collect()] == ["1", "2", "5", "0", "3", "4"]
    banded = order.run(pages(spark).withColumn("order_strategy", F.lit("band_based")), blocks(spark, rows[:2]))[1]
    assert [r["text"] for r in banded.orderBy("seq").collect()] == ["1", "0"]


def test_tables(spark):
    ruled = spark.createDataFrame([("d", 0, 0, None, [["Name", "Age", "City"], ["Alice", "30", None]])], f"doc_id string, page_num int, table_no int, bbox {BOX}, rows array<array<string>>")
    t = tables.ruled_tables(ruled, pages(spark)).first()
    assert t["text"] == "Name\tAge\tCity\nAlice\t30\t" and t["confidence"]["type_quality"] == 0.9 and t["bbox"]["x1"] == 595
    df = spark.createDataFrame([([10.0, 10.5, 11.0, 20.0, 20.5],), ([0.0, 12.0, 24.0, 36.0, 48.0],), ([],)], "y array<double>")
    assert [r["r"] for r in df.select(tables.row_numbers(F.col("y")).alias("r")).collect()] == [[0, 0, 0, 1, 1], [0, 1, 2, 3, 4], []]
    at = [(c, x) for c, x in zip("Revenue 1,200", [0, 3, 6, 9, 12, 15, 18, 21, 60, 63, 66, 69, 72])]
    parts = spark.createDataFrame([("Revenue 1,200", [(c, float(x)) for c, x in at])], "t string, p array<struct<ch:string,x:double>>").select(tables.split_on_gaps(F.col("t"), F.lit(0.0), F.lit(75.0), F.col("p")).alias("s")).first()["s"]
    assert [p["text"] for p in parts] == ["Revenue", "1,200"]
    body = [("d", 0, 0, "inside", (10.0, 10.0, 20.0, 20.0), "body"), ("d", 0, 1, "outside", (200.0, 200.0, 300.0, 220.0), "body"), ("d", 0, 2, "none", None, "body")]
    table = blocks(spark, [("d", 0, 9, "", (0.0, 0.0, 100.0, 100.0), "table")])
    assert sorted(r["text"] for r in tables.absorb(blocks(spark, body), table).collect()) == ["none", "outside"]
    assert tables.drop_dominated(table, table).count() == 0
    grid = [("d", 0, i, f"left{i} right{i}", (50.0, 100.0 + 30 * i, 450.0, 110.0 + 30 * i), "body") for i in range(3)]
    made = tables.run(pages(spark), blocks(spark, grid), ruled.where("false"), DEFAULT.__class__(compat=False))
    assert [r["text"] for r in made.collect()] == ["left0\tright0\nleft1\tright1\nleft2\tright2"]


def test_ocr(spark):
    schema = "doc_id string, page_num int, i int, text string, conf double, `left` int, top int, width int, height int, block_num int, par_num int"
    words = spark.createDataFrame([("d", 0, 0, "Hello", 90.0, 10, 10, 50, 10, 1, 1), ("d", 0, 1, "world", 80.0, 70, 10, 50, 10, 1, 1), ("d", 0, 2, " ", 99.0, 0, 0, 50, 10, 1, 1), ("d", 0, 3, "x", -1.0, 0, 0, 50, 10, 1, 2), ("d", 0, 4, "y", 90.0, 0, 0, 2, 2, 1, 2)], schema)
    p = ocr.paragraphs(words).collect()
    assert len(p) == 1 and p[0]["text"] == "Hello world" and p[0]["bbox"]["x1"] == 120 and abs(p[0]["confidence"]["method_score"] - 0.85) < 1e-9
    routes = spark.createDataFrame([("cjk", 99.0, False), ("arabic", None, True), ("latin", 75.0, True), ("latin", 40.0, True), ("latin", 40.0, False)], "s string, m double, o boolean")
    assert [r["r"] for r in routes.select(ocr.route(F.col("s"), F.col("m"), F.col("o")).alias("r")).collect()] == ["surya", "surya", "tesseract", "surya", "tesseract_low"]
    kept, _ = ocr.run(pages(spark).withColumn("triage_result", F.lit("text_native")), blocks(spark, [("d", 0, 0, "old", None, "body")]), words)
    assert [r["text"] for r in kept.collect()] == ["old"]
    replaced, said = ocr.run(pages(spark).withColumn("triage_result", F.lit("ocr_needed")), blocks(spark, [("d", 0, 0, "old", None, "body")]), words.withColumn("conf", F.lit(30.0)))
    assert [r["text"] for r in replaced.collect()][0].startswith("Hello") and said.count() == 1
    df = spark.createDataFrame([(600, 400, math.radians(8)), (0, 5, 1.0), (600, 400, 0.0)], "w int, h int, t double")
    turned, empty, flat = (tuple(r["r"]) for r in df.select(G.inscribed(F.col("w"), F.col("h"), F.col("t")).alias("r")).collect())
    assert turned[0] < 600 and turned[1] < 400 and empty == (0, 5) and flat == (600, 400)
    for degrees in (-20, -4, 0, 0.05, 3, 7):  # lines of words that fall to the right
        yy, xx = np.mgrid[0:500, 0:700] - np.array([250.0, 350.0])[:, None, None]
        a = math.radians(degrees)
        u, v = xx * math.cos(a) + yy * math.sin(a), -xx * math.sin(a) + yy * math.cos(a)
        page = np.where((np.abs(u) < 220) & (np.abs(v) < 150) & (v % 30 < 9) & (u % 40 < 33), 0, 255)
        assert ocr.skew_angle(page) == pytest.approx(degrees, abs=0.3)
        flat, warned = ocr.prepare(np.dstack([page] * 3))
        assert set(np.unique(flat)) <= {0, 255} and (warned is not None) == (degrees == -20)
        if degrees in (-4, 3, 7):
            assert flat.shape[0] < 500 and abs(ocr.skew_angle(np.where(ocr.turned(page, degrees) > 0, 255, 0))) < 0.4
    assert ocr.skew_angle(np.full((50, 50), 255)) == 0
    two = np.dstack([np.where(np.arange(100) < 50, np.arange(100), 200).reshape(10, 10)] * 3)
    assert set(np.unique(ocr.binarise(two))) == {0, 255}


def test_assembly(spark):
    lines = [("d", 0, i, f"line {i}", (60.0, 110.0 + 20 * i, 400.0, 125.0 + 20 * i), "body") for i in range(12)]
    native = blocks(spark, lines, confidence=B.confidence(text_quality=F.lit(0.9)))
    region = blocks(spark, [("d", 0, 99, "", (50.0, 100.0, 500.0, 400.0), "body")], extraction_method=F.lit("surya_layout"))
    done, _ = assembly.run(native.unionByName(region))
    assert [r["text"] for r in done.collect()] == ["\n".join(f"line {i}" for i in range(12))]
    poor = B.with_confidence(native, text_quality=F.lit(0.2))
    done, said = assembly.run(poor.unionByName(region.withColumn("text", F.lit("region text"))))
    assert [r["text"] for r in done.collect()] == ["region text"] and said.count() == 0
    assert assembly.run(poor.unionByName(region))[1].count() == 1
    loose = blocks(spark, [("d", 0, 50, "loose", (10.0, 700.0, 40.0, 720.0), "body")])
    done, _ = assembly.run(native.unionByName(region).unionByName(loose))
    assert [r["text"] for r in done.orderBy("seq").collect()][-1] == "loose"
    assert assembly.run(native)[0].count() == 12


def test_fingerprints(spark):
    assert texts(spark, X.fingerprint, "3.1 Methods", "Introduction 7", "Page 7", "42", "1.2.3 Subsection", "") == ["methods", "introduction", "page", "#", "subsection", ""]


def test_headers_and_footers(spark):
    rows = []
    for p in range(10):
        rows += [("d", p, 0, "Journal of Things", (50.0, 10.0, 300.0, 22.0), "body"), ("d", p, 1, f"Words of page {'abcdefghij'[p]}", (50.0, 300.0, 300.0, 312.0), "body"), ("d", p, 2, f"Page {p}", (50.0, 820.0, 300.0, 832.0), "body")]
    got = crosspage.promote(blocks(spark, rows), pages(spark, 10)).groupBy("block_type").count().collect()
    assert {r["block_type"]: r["count"] for r in got} == {"header": 10, "footer": 10, "body": 10}
    few = crosspage.promote(blocks(spark, rows[:6]), pages(spark, 2))
    assert few.where("block_type <> 'body'").count() == 0
    assert crosspage.promote(blocks(spark, rows[:9]), pages(spark, 3)).where("block_type = 'header'").count() == 3


def test_heading_tree(spark):
    def tree(heights):
        rows = [("d", 0, i, f"h{i}", (0.0, 50.0 * i, 100.0, 50.0 * i + h), "heading") for i, h in enumerate(heights)]
        made = crosspage.nest_headings(blocks(spark, rows))
        name = {r["block_id"]: r["text"] for r in made.collect()}
        return [name.get(r["parent_id"]) for r in made.orderBy("seq").collect()], made

    assert tree([24.0, 16.0])[0] == [None, "h0"]
    assert tree([24.0, 16.0, 24.0, 16.0])[0] == [None, "h0", None, "h2"]
    parents, made = tree([32.0, 22.0, 14.0])
    assert parents == [None, "h0", "h1"]
    assert [r["depth"] for r in crosspage.heading_depths(made).join(made, ["doc_id", "block_id"]).orderBy("seq").collect()] == [1, 2, 3]
    assert one(spark, crosspage.level_heights(F.array(*[F.lit(x) for x in (24.0, 23.0, 20.0, 19.0, 12.0)]))) == [24.0, 20.0, 12.0]
    long = [[24.0, 20.0, 16.0][i] for i in np.random.default_rng(3).integers(0, 3, 40)]
    want, last = [], {}
    order_ = sorted(set(long), reverse=True)
    for i, h in enumerate(long):
        level = order_.index(h)
        want.append(last.get(level - 1))
        last = {k: v for k, v in last.items() if k < level} | {level: f"h{i}"}
    assert tree(long)[0] == want


def test_heading_tree_of_many_levels(spark):
    for n in (13, 14, 40):
        rows = [("d", 0, i, f"h{i}", (0.0, 300.0 * i, 100.0, 300.0 * i + 200 - 4.0 * i), "heading") for i in range(n)]
        made = crosspage.nest_headings(blocks(spark, rows))
        name = {r["block_id"]: r["text"] for r in made.collect()}
        assert [name.get(r["parent_id"]) for r in made.orderBy("seq").collect()] == [None] + [f"h{i}" for i in range(n - 1)]


def plain_rejoin(items):
    import re

    b = [re.sub(r"(\w+)-\s*[\r\n]+\s*(\w+)", r"\1\2", t) for t in items]
    for i in range(len(b) - 1):
        tail, head = re.search(r"(\w+)-\s*$", b[i]), re.match(r"\s*(\w+)", b[i + 1])
        if tail and head:
            b[i], b[i + 1] = b[i][: tail.start(1)] + tail[1] + head[1], b[i + 1][head.end() :]
    return [t for t in b if t.strip()]


def test_hyphens(spark):
    import random

    r = random.Random(5)
    cases = [["the connec-", "tion of the"], ["pro-", "duc-", "tion pipeline"], ["a well-known thing", "next"], ["two\nli- \n nes", "x"]] + [[r.choice(["foo-", "bar- ", "a b-", "- x", "word", "x-y", " in-", "..."]) for _ in range(8)] for _ in range(40)]
    rows = [(str(d), i // 3, i % 3, t, None, "body") for d, c in enumerate(cases) for i, t in enumerate(c)]
    got = {}
    for x in post.rejoin(blocks(spark, rows)).orderBy("page_num", "seq").collect():
        got.setdefault(int(x["doc_id"]), []).append(x["text"])
    assert [got.get(d, []) for d in range(len(cases))] == [plain_rejoin(c) for c in cases]


def test_ocr_fixes(spark):
    en = blocks(spark, [("d", 0, 0, "arnount of vvater", None, "body")], extraction_method=F.lit("tesseract_ocr"), language=F.lit("en-GB"))
    assert post.correct(en).first()["text"] == "amount of water"
    for other in (en.withColumn("language", F.lit("de")), en.withColumn("language", F.lit(None).cast("string")), en.withColumn("extraction_method", F.lit("pymupdf_direct"))):
        assert post.correct(other).first()["text"] == "arnount of vvater"
    assert post.correct(en, F.array(F.lit("water"))).first()["text"] == "arnount of water"
    assert texts(spark, X.clean_replacements, "a��b", "� �", "ok", "") == ["a[?]b", "", "ok", ""]
    assert texts(spark, X.collapse_spaced, "T I T L E", "USA IS IN", "ok A B") == ["TITLE", "USAISIN", "ok A B"]


def test_scores(spark):
    assert texts(spark, score.plain_quality, "����", "ab��", "abc\x07d", "") == [0, 0.5, 0.8, 1]
    rows = [("d", 0, i, "text", None, "body") for i in range(4)]
    methods = F.element_at(F.array(*[F.lit(m) for m in X.TRUST]), F.col("seq") + 1)
    got = [r["confidence"]["final"] for r in score.run(blocks(spark, rows, extraction_method=methods)).orderBy("seq").collect()]
    assert got == pytest.approx([(1.0 * t * 0.8 * 0.7) ** 0.25 for t in X.TRUST.values()])
    both = score.documents(score.run(blocks(spark, rows)), pages(spark).unionByName(pages(spark, doc="empty")))
    assert {r["doc_id"]: round(r["confidence"], 4) for r in both.collect()} == {"d": round(0.56**0.25, 4), "empty": 0.0}


def test_formats(spark):
    rows = [("d", 0, 0, "Title", (0.0, 0.0, 10.0, 20.0), "heading"), ("d", 0, 1, "a\tb", None, "table"), ("d", 0, 2, "fig", None, "caption"), ("d", 0, 3, "note", None, "footnote"), ("d", 0, 4, " text ", None, "body"), ("d", 0, 5, "head", None, "header"), ("d", 0, 6, "  ", None, "body")]
    b = score.run(blocks(spark, rows))
    assert sinks.markdown(b, strip_headers=True).first()["text"] == "# Title\n\n```\na\tb\n```\n\n*fig*\n\n> note\n\ntext\n"
    assert sinks.plain(b).first()["text"] == "Title\n\na\tb\n\nfig\n\nnote\n\ntext\n\nhead"
    assert sinks.plain(b, threshold=0.99).count() == 0
    assert B.duplicate_ids(b).count() == 0 and B.dangling_parents(b).count() == 0


def test_plans_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(tuple, queries.QUERIES["promote_blocks"](spark, "/root/testdata/sf0.001").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def pdf(folder, name, page_lines):
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [] /MediaBox [0 0 595 842] >>"]
    for lines in page_lines:
        body = b"BT /F1 10 Tf 14 TL 60 790 Td " + b" T* ".join(b"(" + t.encode("latin-1") + b") Tj" for t in lines) + b" ET"
        objects += [b"<< /Type /Page /Contents %d 0 R >>" % (len(objects) + 2), b"<< /Length %d >>\nstream\n" % len(body) + body + b"\nendstream"]
    (folder / name).write_bytes(b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + b"<< /Title (My title) >>\n%%EOF")


def test_files_end_to_end(spark, tmp_path, capsys):
    pdf(tmp_path, "a.pdf", [["Running head"] + [f"Line {i} of page {p} has words enough for a dense page of text" for i in range(12)] for p in range(3)])
    (tmp_path / "bad.pdf").write_bytes(b"junk")
    made = pipeline.extract(spark, str(tmp_path), output_format="plain")
    assert made.pages.count() == 3 and made.failures.count() == 1 and "Line 3 of page 1" in made.texts.first()["text"]
    assert decode.pages_of(decode.decode(decode.files(spark, str(tmp_path)))).first()["title"] == "My title"
    out = tmp_path / "out"
    assert sinks.write_documents(made.texts, str(out), "txt").count() == 1 and (out / "a.txt").exists()
    assert cli.main(["info", str(tmp_path), "--json"], spark) == 0 and '"page_count": 3' in capsys.readouterr().out
    boxes = [tuple(b["bbox"]) for b in made.blocks.where("page_num = 1").collect()]
    assert boxes and all(60 <= x0 < x1 <= 595 and 40 < y0 < y1 < 250 for x0, y0, x1, y1 in boxes)  # from the file: 13 lines of 14 points below 790
    assert cli.main(["info", str(tmp_path / "nothing")], spark) == 1
    assert cli.main(["version", "-v"]) == 0
    with pytest.raises(ValueError):
        pipeline.extract(spark, str(tmp_path), output_format="html")


def test_landing_stream(spark, tmp_path):
    from quire.streaming import landing

    (tmp_path / "in").mkdir()
    pdf(tmp_path / "in", "a.pdf", [["Some words on one page"] * 3])
    q = landing.extract_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), output_format="plain")
    q.awaitTermination()
    assert "Some words" in spark.read.parquet(str(tmp_path / "out/texts")).first()["text"]
