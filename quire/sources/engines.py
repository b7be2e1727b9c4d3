"""Contracts for engines that need a raster or a model: they run on the executors, on one page at a time.

No such engine is in the library. An Engine says how to make one; it is made once for each worker process, if enough memory
is free, and gets (content of the file, page number, width and height in points). What it raises costs its page only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.config import DEFAULT
from quire.functions import text as X
from quire.schema import BBOX, OCR_WORD, REGION, RULED_TABLE

PAGE = "doc_id string, page_num int, "


@dataclass(frozen=True)
class Engine:
    """name: under which a worker keeps it; make: gives the function of a page; least_gib: memory that must be free to make it."""

    name: str
    make: Callable[[], Callable[[bytes, int, float, float], list]]
    least_gib: float = 0.0


_MADE: dict[str, Callable | None] = {}


def free_gib() -> float:
    """Memory that is available on this machine, without bound where it can't be told."""
    try:
        with open("/proc/meminfo", encoding="ascii") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("MemAvailable")) / 2**20
    except (OSError, StopIteration):
        return float("inf")


def made(engine: Engine) -> Callable | None:
    """The engine of this process; None where memory is short."""
    if engine.name not in _MADE:
        if free_gib() < engine.least_gib:
            return None
        _MADE[engine.name] = engine.make()
    return _MADE[engine.name]


def scan(files: DataFrame, pages: DataFrame, engine: Engine, columns: str) -> DataFrame:
    """doc_id, page_num and the columns of what the engine returns for each page, a list of dicts."""
    schema = to_arrow_schema(T._parse_datatype_string(PAGE + columns))
    by = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_num", "width", "height"))).alias("pages"))
    work = files.select(F.col("path").alias("doc_id"), "content").join(by, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = made(engine)
        if own is None:
            return
        for b in batches:
            for i in range(b.num_rows):
                doc, content = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                for p in b.column(2)[i].as_py():
                    try:
                        rows = [{"doc_id": doc, "page_num": p["page_num"]} | dict(r) for r in own(content, p["page_num"], p["width"], p["height"])]
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    except Exception:  # no result for this page
                        continue

    return work.mapInArrow(run, PAGE + columns)


def regions(files: DataFrame, pages: DataFrame, engine: Engine, dpi: int = DEFAULT.layout_dpi) -> DataFrame:
    """REGION rows from dicts of x0, y0, x1, y1 in pixels at `dpi`, and label (Text where null) and confidence (1.0 where null)."""
    found = scan(files, pages, engine, "i int, x0 double, y0 double, x1 double, y1 double, label string, confidence double")
    pt = lambda c: F.col(c) * (72.0 / max(dpi, 1))
    box = F.struct(*(pt(c).alias(c) for c in ("x0", "y0", "x1", "y1")))
    made_ = found.select("doc_id", "page_num", F.col("i").alias("region_seq"), box.alias("bbox"), F.coalesce("label", F.lit("Text")).alias("label"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))
    return made_.select(*(c.split()[0] for c in REGION.split(", ") if " " in c))


def ruled_tables(files: DataFrame, pages: DataFrame, engine: Engine) -> DataFrame:
    """RULED_TABLE rows from one dict a page of tables (rows of cells) and boxes: the n-th table has the n-th box, the rest of the longer list is left out."""
    found = scan(files, pages, engine, f"tables array<array<array<string>>>, boxes array<{BBOX}>")
    n = F.least(F.size("tables"), F.size("boxes"))
    pairs = F.arrays_zip(F.slice("tables", 1, n).alias("rows"), F.slice("boxes", 1, n).alias("bbox"))
    on = found.where(n > 0).join(pages.select("doc_id", "page_num", "width", "height"), ["doc_id", "page_num"])
    rows = on.select("doc_id", "page_num", "width", "height", F.posexplode(pairs).alias("table_no", "t"))
    full = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"))
    return rows.select("doc_id", "page_num", "table_no", F.coalesce("t.bbox", full).alias("bbox"), F.col("t.rows").alias("rows")).where(F.size("rows") > 0)


def ocr_words(files: DataFrame, pages: DataFrame, engine: Engine) -> DataFrame:
    """OCR_WORD rows from dicts of its columns."""
    return scan(files, pages, engine, OCR_WORD.removeprefix(PAGE))


def scripts(files: DataFrame, pages: DataFrame, engine: Engine) -> DataFrame:
    """doc_id, page_num and script family from dicts of osd, the script's name as an orientation and script detector tells it."""
    return scan(files, pages, engine, "osd string").groupBy("doc_id", "page_num").agg(X.osd_script(F.first("osd")).alias("script"))


def samples(files: DataFrame, pages: DataFrame, engine: Engine) -> DataFrame:
    """doc_id, page_num and s4: how far the words of a crop's OCR and of the text layer there agree, from dicts of ocr and layer; null where either is empty or the page is under 10 points."""
    big = pages.where((F.col("width") >= 10) & (F.col("height") >= 10))
    found = scan(files, big, engine, "ocr string, layer string").where(~X.blank(F.col("ocr")) & ~X.blank(F.col("layer")))
    return found.groupBy("doc_id", "page_num").agg(F.max(X.jaccard(F.col("ocr"), F.col("layer"))).alias("s4"))
