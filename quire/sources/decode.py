"""Files to decoded layers. A decoder is a function from bytes to layers; errors become rows, never exceptions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions import text as X
from quire.schema import BBOX, RAW_BLOCK
from quire.sources import pdf

#: A decoder gets the bytes of a file and a password, and returns its title and pages.
Decoder = Callable[[bytes, str | None], tuple[str | None, list[pdf.Page]]]

BLOCKS = "array<struct<" + RAW_BLOCK.split("page_num int, ")[1].replace("block_no int, type int, bbox ", "block_no:int,type:int,bbox:").replace(", lines ", ",lines:") + ">>"
DECODED = f"doc_id string, title string, page_num int, width double, height double, text string, image_boxes array<{BBOX}>, blocks {BLOCKS}, error string"


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, content and length of every matching file below a folder, or of one file."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if not path.lower().endswith(pattern[1:]):
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "content", "length")


DECODERS: dict[str, Decoder] = {"simple": pdf.read}


def register_decoder(name: str, decoder: Decoder) -> None:
    """Makes another reader known, for files the simple one can't read."""
    DECODERS[name] = decoder


def decode(found: DataFrame, decoder: str | Decoder = "simple", password: str | None = None) -> DataFrame:
    """A row for each page, with an error where it can't be read, and one with an error for each file without any.

    A task holds the files of its partition (of spark.sql.files.maxPartitionBytes at most) and the pages of one of them.
    """
    read = DECODERS[decoder] if isinstance(decoder, str) else decoder
    schema = to_arrow_schema(T._parse_datatype_string(DECODED))

    def rows(path: str, data: bytes) -> list[dict]:
        none = dict.fromkeys(schema.names) | {"doc_id": path}
        try:
            title, pages = read(bytes(data), password)
        except Exception as e:  # a broken file must not end the job: it becomes a row
            return [none | {"error": str(e) or type(e).__name__}]
        box = lambda b: dict(zip(("x0", "y0", "x1", "y1"), b))
        told = [none | {"title": title, "page_num": k, "width": float(p.width), "height": float(p.height), "text": p.text, "image_boxes": [box(b) for b in p.images], "blocks": p.blocks or None, "error": p.error} for k, p in enumerate(pages)]
        return told or [none | {"title": title, "error": "no pages"}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_pylist(rows(b.column(0)[i].as_py(), b.column(1)[i].as_py()), schema=schema)

    return found.select("path", "content").mapInArrow(run, DECODED)


def pages_of(decoded: DataFrame) -> DataFrame:
    return decoded.where("page_num IS NOT NULL").withColumn("title", F.nullif("title", F.lit(""))).drop("error", "blocks")


def raw_blocks(decoded: DataFrame) -> DataFrame:
    """RAW_BLOCK rows of the pages whose decoder tells the place of each character."""
    return decoded.where("page_num IS NOT NULL").select("doc_id", "page_num", F.explode("blocks").alias("b")).select("doc_id", "page_num", "b.*")


def page_errors(decoded: DataFrame) -> DataFrame:
    """Warnings of the pages that could not be read."""
    bad = decoded.where("page_num IS NOT NULL AND error IS NOT NULL")
    return bad.select("doc_id", "page_num", F.lit(0).alias("stage"), F.lit(0).alias("seq"), F.concat(F.lit("stage0: page can't be read: "), F.col("error")).alias("msg"))


def failures(decoded: DataFrame) -> DataFrame:
    """path and warning of files that gave no pages."""
    said = F.when(X.is_encryption_error(F.col("error")), F.concat(F.lit("encrypted file: "), F.col("error"))).otherwise(F.concat(F.lit("cannot open file: "), F.col("error")))
    return decoded.where("page_num IS NULL").select(F.col("doc_id").alias("path"), said.alias("message"))


def text_blocks(decoded: DataFrame, cfg=None) -> DataFrame:
    """Blocks from the plain text of pages, a line each, for decoders that don't tell where characters are: they have no boxes."""
    from quire.operators import blocks as B

    pages = decoded.where("page_num IS NOT NULL AND blocks IS NULL")
    rows = pages.select("doc_id", "page_num", F.posexplode(F.split("text", "\n")).alias("seq", "text")).where(~X.blank(F.col("text")))
    rows = rows.withColumn("text", X.strip(F.col("text"))).withColumns({"confidence": B.confidence(text_quality=X.quality(F.col("text"), F.lit(None).cast("string"))), "script_direction": X.direction(F.col("text"))})
    return B.as_blocks(rows, "s1")
