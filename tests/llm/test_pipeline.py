"""The corpus pipeline, stage by stage, against brute force over the same rows."""

import random
from pathlib import Path
from urllib.parse import unquote, urlparse

import pytest

import corpus_pipeline
from quire.llm import chunks, decontaminate, quality
from tests.llm.test_operators import altered, labelled, plain_dedup, plain_pairs, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    good = [(i, t, y) for i, t, y in labelled(60)]
    item = prose(4242, 30)
    passage = prose(777, 90)
    more = [(3000, prose(1, 120)), (3001, altered(prose(1, 120), 0.03, 1)), (3002, prose(2, 60) + " " + item), (3003, prose(3, 60) + " " + passage), (3004, prose(5, 60) + " " + passage + " " + prose(6, 20)), (3005, None), (3006, ""), (None, "no id " + prose(8, 30))]
    rows = [(i, t) for i, t, _ in good] + more
    random.Random(1).shuffle(rows)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, _, y in good], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, item


def test_stages_keep_the_columns_and_take_effect(spark, folder):
    d, rows, item = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, d)
        if name != "packing":
            assert docs.dtypes == before.dtypes, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append((name, before, docs))
    names = [s[0] for s in seen]
    assert names == ["quality", "near_duplicates", "substring_dedup", "decontamination", "packing"]
    _, before, after = seen[0]
    model = quality.fit(before, spark.read.parquet(f"{d}/labels.parquet"))
    want = sorted(repr(r["doc_id"]) for r in before.collect() if model.judge(r["text"])[1] >= 0.5)
    assert sorted(repr(r["doc_id"]) for r in after.collect()) == want
    _, before, after = seen[1]
    pairs = plain_pairs([(r["doc_id"], r["text"]) for r in before.collect()])
    gone = {b for _, b in pairs}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - gone and (3000, 3001) in pairs
    _, before, after = seen[2]
    want = plain_dedup([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in after.collect()} == {(r["doc_id"], t := want.get((r["doc_id"], r["text"]), r["text"]), None if t is None else len(t)) for r in before.collect()}
    _, before, after = seen[3]
    assert {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect() if " ".join(decontaminate.words(item)) in " ".join(decontaminate.words(r["text"] or ""))} == {3002}
    windows = seen[4][2].collect()
    assert {p["doc_id"] for w in windows for p in w["pieces"]} == {r["doc_id"] for r in seen[3][2].collect() if r["text"]}


def tables(spark, path, rows, labels, items):
    spark.createDataFrame([(*r, "en", "s", len(r[1] or ""), 7, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, __id int, key int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_awkward_tables(spark, tmp_path):
    none = tables(spark, tmp_path / "none", [], [], [])
    assert corpus_pipeline.run(spark, none).count() == 0
    rows = [(1, None), (2, ""), (None, "some words here " + prose(9, 20)), (3, "word " * 40_000), (4, "!!! ???"), (5, "same text twice over"), (5, "same text twice over"), (None, None), (6, prose(6, 50)), (7, prose(6, 50))]
    d = tables(spark, tmp_path / "odd", rows, [(None, 1, 0), (3, None, None)], [(None, None), (0, "x")])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), docs.schema)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect()) == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (False, 5), (False, 6), (True, 0), (True, 0)]
    windows = corpus_pipeline.run(spark, d).collect()
    assert sorted({(p["doc_id"] is None, p["doc_id"] or 0) for w in windows for p in w["pieces"]}) == [(False, 3), (False, 4), (False, 5), (False, 6), (True, 0)]


def test_run_gives_the_last_stage(spark, folder):
    d, _, _ = folder
    out = corpus_pipeline.run(spark, d)
    assert [p.name for p in Path(unquote(urlparse(out.inputFiles()[0]).path)).parents[1].iterdir()] == ["4-packing"]  # no other stage's rows are left
    assert out.columns == ["window_id", "used", "pieces"] and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and chunks.GEAR.shape == (256,)
