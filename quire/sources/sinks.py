"""Plain text, Markdown and JSON of documents, and where they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import crosspage


def shown(blocks: DataFrame, strip_headers: bool = False, threshold: float = 0.0) -> DataFrame:
    """Blocks that are printed, their text without outer white space."""
    rows = blocks.where((F.col("confidence.final") >= threshold) & ~X.blank(F.col("text")))
    if strip_headers:
        rows = rows.where(~F.col("block_type").isin("header", "footer"))
    return rows.withColumn("text", X.strip(F.col("text")))


def _joined(rows: DataFrame, line: Column, by: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_num", "seq", line.alias("line")))), lambda r: r["line"])
    return rows.groupBy("doc_id").agg(F.array_join(parts, by).alias("text"))


def plain(blocks: DataFrame, strip_headers: bool = False, threshold: float = 0.0) -> DataFrame:
    """doc_id and text, blocks in order with an empty line between."""
    return _joined(shown(blocks, strip_headers, threshold), F.col("text"), "\n\n")


def markdown(blocks: DataFrame, strip_headers: bool = False, threshold: float = 0.0) -> DataFrame:
    depth = crosspage.heading_depths(blocks)
    rows = shown(blocks, strip_headers, threshold).join(depth, ["doc_id", "block_id"], "left")
    t, kind = F.col("text"), F.col("block_type")
    line = F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce("depth", F.lit(1))), F.lit(" "), t)).when(kind == "table", F.concat(F.lit("```\n"), t, F.lit("\n```"))).when(kind == "caption", F.concat(F.lit("*"), t, F.lit("*"))).when(kind == "footnote", F.concat(F.lit("> "), t)).otherwise(t)
    return _joined(rows, F.concat(line, F.lit("\n")), "\n")


def collected_warnings(warnings: DataFrame) -> DataFrame:
    """doc_id and its messages: those of the document first, then page by page."""
    order = F.struct(F.coalesce("page_num", F.lit(-1)), "stage", "seq", "msg")
    return warnings.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda w: w["msg"]).alias("warnings"))


def payload(pages: DataFrame, blocks: DataFrame, scores: DataFrame, texts: DataFrame, warnings: DataFrame, elapsed: float | None = None) -> DataFrame:
    """doc_id and json: source, confidence, elapsed seconds of the run (if given), warnings, triage counts, blocks, pages and text."""
    n = blocks.groupBy("doc_id", "page_num").agg(F.count("*").alias("blocks"))
    said = warnings.where("page_num IS NOT NULL").groupBy("doc_id", "page_num").agg(F.transform(F.array_sort(F.collect_list(F.struct("stage", "seq", "msg"))), lambda w: w["msg"]).alias("warnings"))
    none = F.array().cast("array<string>")
    rows = pages.select("doc_id", "page_num", F.col("triage_result").alias("triage")).join(n, ["doc_id", "page_num"], "left").join(said, ["doc_id", "page_num"], "left")
    page = F.struct("page_num", "triage", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("warnings", none).alias("warnings"))
    kinds = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.count_if(F.col("triage") == k)) for k in ("text_native", "ocr_needed", "hybrid")]))
    by = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"), kinds.alias("triage"), F.sum(F.coalesce("blocks", F.lit(0))).alias("total_blocks"))
    whole = by.join(scores, "doc_id", "left").join(texts, "doc_id", "left").join(collected_warnings(warnings), "doc_id", "left")
    out = F.struct(F.col("doc_id").alias("source"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.round(F.lit(elapsed).cast("double"), 2).alias("elapsed_seconds"), F.coalesce("warnings", none).alias("warnings"), "triage", "total_blocks", "pages", F.coalesce("text", F.lit("")).alias("text"))
    return whole.select("doc_id", F.to_json(out).alias("json"))


def summary(scores: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: files read, failed, and the mean confidence of those read."""
    ok = scores.agg(F.count("*").alias("succeeded"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("avg_confidence"))
    return ok.crossJoin(failures.agg(F.count("*").alias("failed"))).select((F.col("succeeded") + F.col("failed")).alias("total"), "succeeded", "failed", "avg_confidence")


def names(texts: DataFrame, suffix: str) -> DataFrame:
    """texts with the file name of each document: its stem, and a part of its id's hash where several have the same stem."""
    base = F.regexp_extract("doc_id", r"([^/]*?)(?:\.[^./]*)?/?$", 1)
    stem = F.when(base == "", "document").otherwise(base)
    alike = texts.select("doc_id", stem.alias("stem")).distinct().groupBy("stem").agg((F.count("*") > 1).alias("alike"))
    on = texts.withColumn("stem", stem).join(alike, "stem")
    return on.withColumn("name", F.concat("stem", F.when(F.col("alike"), F.concat(F.lit("-"), F.substring(F.md5("doc_id"), 1, 8))).otherwise(""), F.lit(f".{suffix}"))).drop("stem", "alike")


def write_documents(texts: DataFrame, folder: str, suffix: str = "md") -> DataFrame:
    """Writes each document that has text to folder/<name>.<suffix> from the executors, which must all see the folder; returns path, bytes written and whether a file was overwritten."""

    def write(batches):
        import os

        import pandas as pd

        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            done = []
            for name, text in zip(pdf["name"], pdf["text"]):
                path, part = os.path.join(folder, name), os.path.join(folder, f".{name}.{os.getpid()}")
                there = os.path.exists(path)
                with open(part, "w", encoding="utf-8") as f:
                    f.write(text)
                os.replace(part, path)  # a retried task leaves a whole file
                done.append((path, len(text.encode()), there))
            yield pd.DataFrame(done, columns=["path", "bytes", "overwritten"])

    return names(texts.select("doc_id", "text").where("text <> ''"), suffix).select("name", "text").mapInPandas(write, "path string, bytes long, overwritten boolean")


def report(scores: DataFrame, tally: DataFrame) -> str:
    """The console report: a bar for each page class and the documents' bands."""
    rows = {r["triage_result"]: r["count"] for r in tally.collect()}
    total = max(1, sum(rows.values()))
    lines = [f"{k:12} {'#' * min(40, round(40 * n / total))} {n}" for k, n in sorted(rows.items())]
    from quire.operators.score import band

    lines += [f"{r['b']:12} {r['count']} document(s)" for r in scores.groupBy(band(F.col("confidence")).alias("b")).count().orderBy("b").collect()]
    return "\n".join(lines)
