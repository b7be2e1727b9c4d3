"""Bounded-space online packing of documents into token windows.

Documents are tokenised where they lie; only (id, length) is shuffled. Each bucket of documents (by hash of id and
length, so that no id or null ids fill one) is packed in id order with at most `open_windows` windows open: a piece
goes to the window it leaves the least room in (the oldest on a tie); if none fits and no more may be opened, the
fullest is emitted. A full window is emitted at once. Windows that are done stay where they were made; only what is
still open at the end of a bucket, `open_windows` windows at most, is shuffled: that of each run of `merge_buckets`
buckets is merged, fullest first, by the same rule.
A document ends with one separator token; one longer than the window is cut into whole windows and a rest.

Defined results
  null or empty text, text of no tokens   not packed
  null doc_id                             packed, after the others of its bucket
  repeated rows                           each is packed
  ties                                    the order is (bucket, doc_id, length); equal ones are the same piece
  empty table                             an empty result
  extra columns                           ignored, whatever their names
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import column_type, ensure_checkpoint_dir, map_arrow, pick

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The byte-level BPE of a rank file, kept for each worker process."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        _ENCODERS[path] = tiktoken.Encoding(Path(path).stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(docs: DataFrame, tokenizer: str | None, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n: tokens with the separator; rows without tokens are left out. Without tokenizer, UTF-8 bytes are the tokens."""
    texts = pick(docs, doc_id=id_col, text=text_col)
    if tokenizer is None:
        return texts.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("n")).where(F.col("n") > 1)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        enc = encoder(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) + 1 if t else 1 for t in b["text"]]
            keep = [i for i, x in enumerate(n) if x > 1]
            yield {"doc_id": [b["doc_id"][i] for i in keep], "n": [n[i] for i in keep]}

    return map_arrow(texts, run, T.StructType([T.StructField("doc_id", column_type(texts, "doc_id")), T.StructField("n", T.LongType())]))


class Packer:
    """add() returns the windows emitted by a piece; rest() what is still open, oldest first."""

    def __init__(self, window: int, open_windows: int):
        self.window, self.limit = window, open_windows
        self.open: list[list] = []  # [used, pieces], oldest first

    def add(self, size: int, pieces: list[tuple]) -> list[list]:
        best = None
        for w in self.open:
            if w[0] + size <= self.window and (best is None or w[0] > best[0]):
                best = w
        out = []
        if best is None:
            if len(self.open) >= self.limit:
                fullest = max(self.open, key=lambda w: w[0])
                self.open.remove(fullest)
                out.append(fullest)
            best = [0, []]
            self.open.append(best)
        best[0] += size
        best[1] = best[1] + pieces
        if best[0] == self.window:
            self.open = [w for w in self.open if w is not best]
            out.append(best)
        return out

    def rest(self) -> list[list]:
        return self.open


def cut(doc, n: int, window: int) -> list[tuple]:
    return [(doc, s, min(n, s + window)) for s in range(0, n, window)]


def pack_windows(docs: DataFrame, *, window: int = 2048, open_windows: int = 16, tokenizer: str | None = None, rows_per_bucket: int = 20_000, merge_buckets: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """window_id, used, pieces: array of (doc_id, start, end) token ranges, in the order they are laid out."""
    counts = token_counts(docs, tokenizer, id_col, text_col)
    buckets = max(1, math.ceil(docs.count() / rows_per_bucket))
    kind = column_type(counts, "doc_id")
    piece = T.ArrayType(T.StructType([T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("used", T.LongType()), T.StructField("done", T.BooleanType()), T.StructField("pieces", piece)])
    spread = counts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "n"), F.lit(buckets)).cast("long")).repartition(buckets, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_last(), "n")

    def rows(bucket: int, found: list[tuple[list, bool]], seq: int) -> dict:
        return {"bucket": [bucket] * len(found), "seq": list(range(seq, seq + len(found))), "used": [w[0] for w, _ in found], "done": [d for _, d in found], "pieces": [[dict(zip(("doc_id", "start", "end"), p)) for p in w[1]] for w, _ in found]}

    def first(batches: Iterator[dict]) -> Iterator[dict]:
        now, packer, seq = None, None, 0
        for b in batches:
            for bk, doc, n in zip(b["bucket"], b["doc_id"], b["n"]):
                if bk != now:
                    if packer is not None:
                        yield rows(now, [(w, False) for w in packer.rest()], seq)
                    now, packer, seq = bk, Packer(window, open_windows), 0
                out = [(w, True) for p in cut(doc, n, window) for w in packer.add(p[2] - p[1], [p])]
                if out:
                    yield rows(now, out, seq)
                    seq += len(out)
        if packer is not None:
            yield rows(now, [(w, False) for w in packer.rest()], seq)

    def last(batches: Iterator[dict]) -> Iterator[dict]:
        now, packer, seq = None, None, 0

        def told(found: list[list]) -> dict:
            return {"bucket": [-1 - now] * len(found), "seq": list(range(seq, seq + len(found))), "used": [w[0] for w in found], "done": [True] * len(found), "pieces": [w[1] for w in found]}

        for b in batches:
            for g, used, pieces in zip(b["group"], b["used"], b["pieces"]):
                if g != now:
                    if packer is not None:
                        yield told(packer.rest())
                    now, packer, seq = g, Packer(window, open_windows), 0
                out = packer.add(used, pieces)
                if out:
                    yield told(out)
                    seq += len(out)
        if packer is not None:
            yield told(packer.rest())

    ensure_checkpoint_dir(docs.sparkSession)
    packed = map_arrow(spread, _batched(first), schema).checkpoint()
    left = packed.where("NOT done").withColumn("group", F.floor(F.col("bucket") / merge_buckets).cast("long"))
    groups = math.ceil(buckets / merge_buckets)
    merged = packed.where("done").unionAll(map_arrow(left.repartition(groups, "group").sortWithinPartitions("group", F.desc("used"), "bucket", "seq"), _batched(last), schema))
    name = F.when(F.col("bucket") < 0, F.concat(F.lit("m"), (-1 - F.col("bucket")).cast("string"), F.lit("-"), F.col("seq").cast("string"))).otherwise(F.concat(F.lit("b"), F.col("bucket").cast("string"), F.lit("-"), F.col("seq").cast("string")))
    return merged.select(name.alias("window_id"), "used", "pieces")


def _batched(fn, size: int = 2000):
    """Gathers the many small results of fn into batches."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        kept: dict | None = None
        for out in fn(batches):
            if kept is None:
                kept = {k: list(v) for k, v in out.items()}
            else:
                for k, v in out.items():
                    kept[k] += v
            if len(kept["seq"]) >= size:
                yield kept
                kept = None
        if kept is not None:
            yield kept

    return run
