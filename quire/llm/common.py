"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns only, under new names; any other column is ignored, whatever it is called."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and all runs in this process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "quire-checkpoints")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is not needed any more, in whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))


PIECE_ROWS, PIECE_BYTES = 1_000, 8_000_000


def pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most PIECE_ROWS rows and about PIECE_BYTES bytes, so that few rows at a time become Python objects."""
    step = max(1, min(PIECE_ROWS, int(PIECE_BYTES * b.num_rows / max(1, b.nbytes))))
    for at in range(0, b.num_rows, step):
        yield b.slice(at, step)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: T.StructType) -> DataFrame:
    """mapInArrow over column lists: fn gets {column: list} per piece of a batch and yields {column: list or array}."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ins = ({n: p.column(i).to_pylist() for i, n in enumerate(p.schema.names)} for b in batches for p in pieces(b))
        for out in fn(ins):
            arrays = []
            for f in arrow:
                x = out[f.name]
                arrays.append(x if isinstance(x, pa.Array) else pa.array(x, f.type))
            if arrays and len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def sample_by_hash(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most `limit` rows, those of the smallest key hash: the same rows at every run and partitioning.

    Rows are counted first, so that only about `limit` of them are sorted, however many there are.
    """
    h, n = F.xxhash64(F.col(key)), df.count()
    if n > 1.5 * limit + 100:
        df = df.where(h < int(-(2**63) + 2**64 * (1.5 * limit + 100) / n))
    return df.orderBy(h, F.col(key)).limit(limit)


def sample_each_by_hash(df: DataFrame, key: str, kind: str, limit: int) -> DataFrame:
    """At most `limit` rows of each value of `kind`, of the smallest key hashes: the same rows at every run, whatever the partitioning.

    Rows are counted by kind first, so that only about `limit` of each are ranked, however many there are.
    """
    h = F.xxhash64(F.col(key))
    n = df.groupBy(kind).agg(F.count("*").alias("__n")).withColumnRenamed(kind, "__kind")
    near = df.join(small(n), F.col(kind) == F.col("__kind")).where(h < -(2.0**63) + 2.0**64 * (1.5 * limit + 100) / F.col("__n"))
    w = Window.partitionBy(kind).orderBy(h, key)
    return near.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n", "__kind")


def labelled_texts(docs: DataFrame, marks: DataFrame, limits: dict[int, int], most_chars: int) -> list[tuple[int, str]]:
    """(label, text) of a bounded sample, in an order by id hash: whole texts, of at most limits[label] ids a label and `most_chars` characters in all.

    docs has doc_id and text, marks doc_id and label. Lengths come first, so that texts beyond the bound are never sent.
    """
    few = None
    for label, limit in limits.items():
        part = sample_by_hash(marks.where(F.col("label") == label), "doc_id", limit)
        few = part if few is None else few.unionAll(part)
    rows = docs.where(F.length("text") > 0).join(F.broadcast(few), "doc_id").withColumn("h", F.xxhash64("doc_id"))
    most = 4 * sum(limits.values())
    chars, last, whole = 0, None, True
    for r in rows.select("h", F.length("text").alias("n")).orderBy("h").limit(most).collect():
        chars += r["n"]
        if chars > most_chars:
            whole = False
            break
        last = r["h"]
    if not whole:
        rows = rows.where(F.col("h") <= last) if last is not None else rows.limit(0)
    return [(r["label"], r["text"]) for r in rows.orderBy("h", "doc_id", "text").select("label", "text").limit(most).collect()]


BROADCAST_BYTES = 32_000_000


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row of df takes: 16 a value, and what strings, bytes and arrays hold."""
    total = F.lit(16 * len(df.columns)).cast("long")
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            total = total + 32 * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return total


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows take at most `most` bytes, else df for a shuffled join. df is read for this."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df)).alias("n")).first()["n"] or 0) <= most else df


def drop_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """docs without the ids in the one column of `ids`; rows with a null id stay."""
    ensure_checkpoint_dir(docs.sparkSession)
    name = fresh(docs, "__gone")
    gone = ids.toDF(name).checkpoint()
    return docs.join(small(gone), F.col(f"`{id_col}`") == F.col(name), "left_anti")
