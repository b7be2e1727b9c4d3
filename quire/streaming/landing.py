"""Files that land in a folder, extracted as they come; a document arrives whole, so no state crosses batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.config import DEFAULT, EngineConfig
from quire.lineage import cut
from quire.plans import pipeline


def landing(spark: SparkSession, folder: str, pattern: str = "*.pdf", per_trigger: int = 1000) -> DataFrame:
    """path, content, length and time of files as they land; a file told twice within a day is read once."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(folder)
    return found.withWatermark("modificationTime", "1 day").dropDuplicatesWithinWatermark(["path"])


def extract_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, *, decoder="simple", output_format: str = "markdown", cfg: EngineConfig = DEFAULT, available_now: bool = True) -> StreamingQuery:
    """Appends texts, scores, warnings and failures of new files below `out`, each batch under its own number, so a repeated batch replaces itself."""

    def batch(files: DataFrame, number: int) -> None:
        made = pipeline.extract_files(files.sparkSession, cut(files), decoder=decoder, output_format=output_format, cfg=cfg)
        for name, df in (("texts", made.texts), ("scores", made.scores), ("warnings", made.warnings), ("failures", made.failures)):
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    writer = landing(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
