"""Substring deduplication by content-defined chunking.

A gear hash rolls over the UTF-8 bytes: h = 2 h + gear[byte], of which the lowest 16 bits are used, so that it
depends on the last 16 bytes only. A chunk ends where the top `bits` of those are zero, but not within `least`
bytes of its start nor inside a character; where none such comes within `most` bytes it ends at their smallest hash,
so that this place too goes with the content. An insertion therefore moves the chunk ends next to it only. Chunks are
compared by a 128-bit digest (at 10^12 chunks two different ones are equal with a chance of 2e-15). Of equal chunks
the one in the smallest doc_id, and there the first, stays; a run of neighbouring chunks that all have an earlier
copy is removed if it is at least `min_run` characters long, so that short phrases shared by chance are left alone.

Digests are first counted with partial aggregation, so a chunk that millions of documents share costs one row
for each map task; only rows of repeated digests are joined back, and skew there is left to adaptive execution.

Defined results
  null text              stays null, no spans
  empty text             stays empty, no spans
  null doc_id            the text is neither cut nor compared
  repeated rows of one id   parts of one document: none loses what another of them has; equal rows are cut alike
  documents within `least` bytes   one chunk
  empty table            an empty result
  extra columns          ignored by dedup_spans, kept by dedup
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import column_type, ensure_checkpoint_dir, fresh, map_arrow, pick, small

GEAR = np.array([xxhash.xxh3_64_intdigest(bytes([i]), seed=7) & 0xFFFF for i in range(256)], np.uint16)


def gear(raw: np.ndarray) -> np.ndarray:
    """The lowest 16 bits of the gear hash after each byte, by doubling the window."""
    h = GEAR[raw]
    for k in (1, 2, 4, 8):
        if len(h) > k:
            g = h.copy()
            g[k:] += h[:-k] << np.uint16(k)
            h = g
    return h


def cuts(raw: np.ndarray, bits: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of UTF-8 bytes, the last one len(raw)."""
    n = len(raw)
    if not n:
        return []
    head = np.empty(n + 1, bool)  # a character starts here
    head[:n] = (raw & 0xC0) != 0x80
    head[n] = True
    h = gear(raw)
    ends = np.flatnonzero((h >> np.uint16(16 - bits) == 0) & head[1:]) + 1
    out, start = [], 0
    for e in ends.tolist() + [n]:
        while e - start > most:
            start += least + int(np.argmin(np.where(head[start + least : start + most + 1], h[start + least - 1 : start + most], 0xFFFF)))
            out.append(start)
        if e - start >= least or (e == n and start < n):
            out.append(e)
            start = e
    return out


def chunk(text: str, bits: int, least: int, most: int) -> list[tuple[tuple[int, int], int, int]]:
    """(digest as two numbers, first, last + 1 character) of each chunk."""
    raw = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8)
    ends = cuts(b, bits, least, most)
    if not ends:
        return []
    if len(raw) == len(text):
        at = ends
    else:
        at = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))[ends].tolist()
    digest = xxhash.xxh3_128_digest
    told = np.frombuffer(b"".join([digest(raw[s:e]) for s, e in zip([0] + ends, ends)]), ">i8").tolist()
    return list(zip(zip(told[::2], told[1::2]), [0] + at, at))


def dedup_spans(docs: DataFrame, *, bits: int = 4, least: int = 16, most: int = 512, min_run: int = 150, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part (a hash of the text) and spans, the character ranges to remove; documents without any are left out."""
    texts = _parts(docs, id_col, text_col).where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    kind = column_type(texts, "doc_id")
    who = [T.StructField("doc_id", kind), T.StructField("part", T.LongType())]

    def digests(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            ids, found, count = [], [], []
            for doc, text in zip(b["doc_id"], b["text"]):
                own: dict[tuple, int] = {}
                for d, _, _ in chunk(text, bits, least, most):
                    own[d] = own.get(d, 0) + 1
                ids += [doc] * len(own)
                found += own.keys()
                count += own.values()
            yield {"d1": [d[0] for d in found], "d2": [d[1] for d in found], "doc_id": ids, "n": count}

    def places(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("d1", "d2", "doc_id", "part", "place")}
            for doc, part, text in zip(b["doc_id"], b["part"], b["text"]):
                own: set[tuple] = set()
                found = chunk(text, bits, least, most)
                out["d1"] += [d[0] for d, _, _ in found]
                out["d2"] += [d[1] for d, _, _ in found]
                out["doc_id"] += [doc] * len(found)
                out["part"] += [part] * len(found)
                for d, s, e in found:  # start, length and whether it is in the text before, in one number
                    out["place"].append(s << 32 | (e - s) << 1 | (d in own))
                    own.add(d)
            yield out

    digest = [T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType())]
    counted = map_arrow(texts.drop("part"), digests, T.StructType([*digest, who[0], T.StructField("n", T.IntegerType())]))
    first = counted.groupBy("d1", "d2").agg(F.sum("n").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1").drop("n")
    rows = map_arrow(texts, places, T.StructType([*digest, *who, T.StructField("place", T.LongType())]))
    start = F.shiftright("place", 32).cast("int")
    end = start + F.shiftright("place", 1).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    later = rows.join(first, ["d1", "d2"]).where((F.col("place") % 2 == 1) | (F.col("doc_id") > F.col("first_id"))).withColumns({"start": start, "end": end})
    w = Window.partitionBy("doc_id", "part").orderBy("start")
    runs = later.select("doc_id", "part", "start", "end").withColumn("new", (F.col("start") > F.coalesce(F.lag("end").over(w), F.lit(-1))).cast("int")).withColumn("run", F.sum("new").over(w)).groupBy("doc_id", "part", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).where(F.col("end") - F.col("start") >= min_run)
    return runs.groupBy("doc_id", "part").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(docs, doc_id=id_col, text=text_col).withColumn("part", F.xxhash64("text"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None, length_col: str | None = None, **options) -> DataFrame:
    """docs with the repeated runs cut out of the text; `spans_col` adds the ranges cut, `length_col` is set to the new length."""
    ensure_checkpoint_dir(docs.sparkSession)
    i, p, c = (fresh(docs, x) for x in ("__id", "__part", "__spans"))
    spans = dedup_spans(docs, id_col=id_col, text_col=text_col, **options).toDF(i, p, c).checkpoint()
    text, cut = F.col(f"`{text_col}`"), F.col(c)
    joined = docs.join(small(spans), (F.col(f"`{id_col}`") == F.col(i)) & (F.xxhash64(text) == F.col(p)), "left")
    starts = F.concat(F.array(F.lit(0)), F.transform(cut, lambda s: s["end"]))
    ends = F.concat(F.transform(cut, lambda s: s["start"]), F.array(F.length(text)))
    kept = F.array_join(F.zip_with(starts, ends, lambda s, e: F.substr(text, s + 1, e - s)), "")
    out = joined.withColumn(text_col, F.when(cut.isNull(), text).otherwise(kept))
    if length_col:
        out = out.withColumn(length_col, F.length(F.col(f"`{text_col}`")).cast(docs.schema[length_col].dataType))
    if spans_col:
        out = out.withColumn(spans_col, F.coalesce(cut, F.array().cast("array<struct<start:int,end:int>>")))
    return out.drop(i, p, c)
