"""Whole runs: decoded layers in, blocks, scores, texts and warnings out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import DEFAULT, EngineConfig
from quire.lineage import cut
from quire.operators import assembly, crosspage, layout, ocr, order, post, score, tables, textlayer, triage
from quire.schema import OCR_WORD, REGION, RULED_TABLE, WARNING
from quire.sources import decode, engines, sinks

FORMATS = ("markdown", "plain", "ir")


@dataclass
class Result:
    pages: DataFrame
    blocks: DataFrame
    scores: DataFrame
    texts: DataFrame
    warnings: DataFrame
    failures: DataFrame | None = None

    def json(self, elapsed: float | None = None) -> DataFrame:
        return sinks.payload(self.pages, self.blocks, self.scores, self.texts, self.warnings, elapsed)


def format_texts(blocks: DataFrame, output_format: str, strip_headers: bool, threshold: float) -> DataFrame:
    if output_format == "ir":
        return blocks.select("doc_id").distinct().withColumn("text", F.lit(""))
    return (sinks.markdown if output_format == "markdown" else sinks.plain)(blocks, strip_headers, threshold)


def run_layers(
    spark: SparkSession, pages: DataFrame, *, raw: DataFrame | None = None, blocks: DataFrame | None = None, regions: DataFrame | None = None, ruled: DataFrame | None = None, words: DataFrame | None = None,
    samples: DataFrame | None = None, others: DataFrame | None = None, dictionary: list[str] | None = None, strategy: str = "xy_cut", output_format: str = "markdown", strip_headers: bool = False, threshold: float = 0.0, cfg: EngineConfig = DEFAULT,
) -> Result:
    """Stages 0 to 9 over decoded tables: character layers (raw), ready blocks, or both, and whatever else was decoded.

    words are those of the first OCR engine, others the regions of the second one, which pages of some scripts or of
    poor results are given to; pages may have a column script.

    Stages read their input several times, so each is written to the shared folder before the next one starts.
    """
    if output_format not in FORMATS:
        raise ValueError(f"output_format must be one of {', '.join(FORMATS)}")
    empty = lambda schema: spark.createDataFrame([], schema)
    sorted_ = cut(triage.triage(pages, cfg))
    warned = sorted_.select("doc_id", "page_num", F.lit(0).alias("stage"), F.posexplode("warnings").alias("seq", "msg"))
    if raw is not None:
        sorted_, found, more = textlayer.extract(sorted_, raw, samples, cfg)
        sorted_, warned = cut(sorted_), warned.unionByName(more)
    if blocks is not None:
        plain = blocks.join(sorted_.where("triage_result <> 'ocr_needed'").select("doc_id", "page_num"), ["doc_id", "page_num"], "left_semi")
        found = plain if raw is None else found.unionByName(plain)
    found = cut(found)
    found, more = layout.run(sorted_, found, regions if regions is not None else empty(REGION), cfg)
    warned = warned.unionByName(more)
    sorted_, found = order.run(sorted_, cut(found), strategy, cfg)
    found = tables.run(sorted_, cut(found), ruled if ruled is not None else empty(RULED_TABLE), cfg)
    found, more = ocr.run(sorted_, cut(found), words if words is not None else empty(OCR_WORD), others, cfg)
    warned = warned.unionByName(more)
    found, more = assembly.run(cut(found), cfg)
    warned = warned.unionByName(more)
    found, more = crosspage.run(sorted_, cut(found), cfg)
    warned = warned.unionByName(more)
    known = None if dictionary is None else F.array(*[F.lit(w) for w in dictionary])
    found = cut(score.run(post.run(cut(found), known)))
    return Result(sorted_, found, score.documents(found, pages), format_texts(found, output_format, strip_headers, threshold), warned.select(*(c.split()[0] for c in WARNING.split(", "))))


def _there(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    if not found:
        raise FileNotFoundError(path)


def layers(spark: SparkSession, files: DataFrame, decoded: DataFrame, plugins: dict[str, engines.Engine]) -> dict[str, DataFrame]:
    """The arguments of run_layers for decoded files; plugins by what they give: regions, ruled, words, others, scripts, samples."""
    pages = decode.pages_of(decoded)
    out = {"raw": decode.raw_blocks(decoded), "blocks": decode.text_blocks(decoded)}
    for name, scan in (("regions", engines.regions), ("ruled", engines.ruled_tables), ("words", engines.ocr_words), ("others", lambda f, p, e: engines.regions(f, p, e, 72)), ("samples", engines.samples)):
        if name in plugins:
            out[name] = cut(scan(files, pages, plugins[name]))
    if "scripts" in plugins:
        pages = pages.join(cut(engines.scripts(files, pages, plugins["scripts"])), ["doc_id", "page_num"], "left")
    return {"pages": pages, **out}


def extract(
    spark: SparkSession, path: str, *, output_format: str = "markdown", decoder="simple", password: str | None = None, strip_headers: bool = False, confidence_threshold: float = 0.0,
    plugins: dict[str, engines.Engine] | None = None, cfg: EngineConfig = DEFAULT,
) -> Result:
    """Everything for a file or a folder of files, as one plan. No such path is a FileNotFoundError; what can't be read is in failures."""
    if output_format not in FORMATS:
        raise ValueError(f"output_format must be one of {', '.join(FORMATS)}")
    _there(spark, path)
    found = decode.files(spark, path)
    return extract_files(spark, found, output_format=output_format, decoder=decoder, password=password, strip_headers=strip_headers, threshold=confidence_threshold, plugins=plugins, cfg=cfg)


def extract_files(spark: SparkSession, found: DataFrame, *, decoder="simple", password: str | None = None, plugins: dict[str, engines.Engine] | None = None, **options) -> Result:
    decoded = cut(decode.decode(found, decoder, password))
    out = run_layers(spark, **layers(spark, found, decoded, plugins or {}), **options)
    out.failures = decode.failures(decoded)
    out.warnings = out.warnings.unionByName(decode.page_errors(decoded))
    return out


def info(spark: SparkSession, path: str, decoder="simple", password: str | None = None) -> DataFrame:
    """Page classes only, without reading any text layer, with the title and the warnings of each document."""
    _there(spark, path)
    decoded = cut(decode.decode(decode.files(spark, path), decoder, password))
    titles = decode.pages_of(decoded).groupBy("doc_id").agg(F.first("title").alias("title"))
    said = sinks.collected_warnings(decode.page_errors(decoded))
    none = F.array().cast("array<string>")
    return triage.info(decode.pages_of(decoded)).join(titles, "doc_id").join(said, "doc_id", "left").withColumn("warnings", F.coalesce("warnings", none))
