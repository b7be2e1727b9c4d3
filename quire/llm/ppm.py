"""Prediction by partial matching over bytes, as code length per document.

The model is a trie of byte contexts up to `order`. A symbol is coded in the longest known context; if it was
not seen there, an escape is coded (method C: distinct symbols over occurrences plus distinct symbols) and the
next shorter context is tried without the symbols already excluded; below order 0 all bytes not seen at all are
equally likely. Texts start in a boundary context (0xFF, which UTF-8 never holds).

Pretrained: counts come from every byte of every document; each partition combines its own counts and only
those are shuffled. Every context with a symbol seen `min_count` times is in the trie, however large the corpus
is, so the trie grows with it (8 bytes a symbol of a context, 20 a context). As counts are then fixed, totals and
exclusions are worked out once for each context, and a document is sorted lookups in numpy, for each distinct
context and symbol of some MB of text. A trie of over `shard_entries` symbols is split by the last byte of the
context, so that the driver, and each worker, holds one part of it at a time.
Adaptive: the trie starts empty for each document and learns as it codes; byte by byte in Python.

Defined results
  null or empty text   n_bytes 0, bits 0.0, bits_per_byte null
  empty corpus         every byte costs 8 bits
  null doc_id          scored like any other
  repeated rows        one result row for each; each counts in training
  extra columns        ignored, whatever their names
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import column_type, ensure_checkpoint_dir, map_arrow, pick

EDGE = 255
SLICE = 2_000_000


def _streams(texts: list, order: int) -> Iterator[tuple[np.ndarray, list[int], list[int]]]:
    """Bytes of some texts, each after `order` edges, with the rows and lengths; long texts are never cut."""
    gap = b"\xff" * order
    parts: list[bytes] = []
    rows: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if not t:
            continue
        parts += (gap, raw := t.encode("utf-8", "replace"))
        rows.append(i)
        size += len(raw)
        if size >= SLICE:
            yield np.frombuffer(b"".join(parts), np.uint8), rows, [len(p) for p in parts[1::2]]
            parts, rows, size = [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), rows, [len(p) for p in parts[1::2]]


def _codes(raw: np.ndarray, order: int) -> np.ndarray:
    """The `order` bytes before each byte and the byte itself, as one number."""
    x = raw.astype(np.uint32 if order <= 3 else np.uint64)
    code = x[order:].copy()
    for k in range(1, order + 1):
        code |= x[order - k : len(x) - k] << x.dtype.type(8 * k)
    return code


def _tail(codes: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes of each code."""
    return codes & codes.dtype.type(256**n - 1)


def _context(codes: np.ndarray) -> np.ndarray:
    return codes >> codes.dtype.type(8)


def _find(known: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each code is in sorted `known`, and whether it is there."""
    if not len(known):
        return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return at, known[at] == codes


def _combine(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    c, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(c, kind="stable")
    c, n = c[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    return c[first], np.add.reduceat(n, first)


def corpus_counts(docs: DataFrame, order: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """order, ctx, sym, n for every context of 0 to `order` bytes (at most 7) of the corpus."""
    schema = T.StructType([T.StructField("order", T.IntegerType()), T.StructField("ctx", T.LongType()), T.StructField("sym", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        codes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0
        for b in batches:
            for raw, _, _ in _streams(b["text"], order):
                c, n = np.unique(_codes(raw, order)[raw[order:] != EDGE], return_counts=True)
                codes.append(c)
                counts.append(n)
                held += len(c)
                if held > 2_000_000:
                    c, n = _combine(codes, counts)
                    codes, counts, held = [c], [n], len(c)
        if not codes:
            return
        c, n = _combine(codes, counts)
        for o in range(order, -1, -1):
            if o < order:
                c, n = _combine([_tail(c, o + 1)], [n])
            for at in range(0, len(c), 100_000):
                part = c[at : at + 100_000]
                yield {"order": np.full(len(part), o, np.int32), "ctx": _context(part).astype(np.int64), "sym": _tail(part, 1).astype(np.int32), "n": n[at : at + 100_000].astype(np.int64)}

    parts = map_arrow(pick(docs, text=text_col), count, schema)
    return parts.repartition("order", "ctx").groupBy("order", "ctx", "sym").agg(F.sum("n").alias("n"))


class Level:
    """One order of the trie: sorted codes of its symbols in context and of its contexts, and what they cost in bits."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, up: Level | None):
        by = np.argsort(codes)
        self.codes, n = codes[by], n[by]
        context = _context(self.codes) if up else np.zeros_like(self.codes)
        self.contexts, first = np.unique(context, return_index=True) if len(codes) or up else (np.zeros(1, codes.dtype), None)
        sums = lambda x: np.add.reduceat(x, first) if len(codes) else np.zeros(len(self.contexts), np.int64)
        self.n, self.total, self.kinds = n, sums(n), sums(np.ones_like(n))
        with np.errstate(divide="ignore", invalid="ignore"):
            self.log_n = np.log2(n).astype(np.float32)
            self.log_all = np.log2(self.total + self.kinds).astype(np.float32)
            self.escape = np.where(self.kinds > 0, np.log2((self.total + self.kinds) / self.kinds), 0).astype(np.float32)
            if up:  # what the next shorter context has without the symbols of this one
                above, _ = _find(up.contexts, _tail(self.contexts, up.size))
                inner, _ = _find(up.codes, _tail(self.codes, up.size + 1))
                rest, left = up.total[above] - sums(up.n[inner]), up.kinds[above] - self.kinds
                self.log_rest = np.log2(rest + left).astype(np.float32)
                self.fall = np.where(left > 0, np.log2((rest + left) / left), 0).astype(np.float32)
        self.size = up.size + 1 if up else 0


class Shard:
    """The trie of all contexts that end in certain bytes, with the root."""

    def __init__(self, levels: list[Level], ends: np.ndarray | None):
        self.levels, self.ends = levels, ends
        self.unseen = math.log2(max(1, 256 - int(levels[0].kinds[0])))
        for x in levels:
            del x.n, x.total, x.kinds

    def cost(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each code after the others, in the longest known context."""
        root = self.levels[0]
        at, seen = _find(root.codes, _tail(codes, 1))
        log_n = root.log_n[at] if len(root.codes) else np.zeros(len(codes), np.float32)
        below = np.full(len(codes), self.unseen)
        cost = np.where(seen, root.log_all[0] - log_n, root.escape[0] + below)
        for o, level in enumerate(self.levels[1:], 1):
            if not len(level.codes):
                break
            c, known = _find(level.contexts, _tail(_context(codes), o))
            below = np.where(seen, level.log_rest[c] - log_n, level.fall[c] + below)
            at, seen = _find(level.codes, _tail(codes, o + 1))
            log_n = level.log_n[at]
            cost = np.where(known, np.where(seen, level.log_all[c] - log_n, level.escape[c] + below), cost)
        return cost

    def bits(self, texts: list, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each text, and bits of those bytes whose context is of this shard."""
        n, out = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for raw, rows, sizes in _streams(texts, order):
            codes, where = np.unique(_codes(raw, order), return_inverse=True)
            own = _tail(codes, 1) != EDGE
            if self.ends is not None:
                own &= self.ends[_tail(_context(codes), 1).astype(np.int64)]
            cost = np.zeros(len(codes))
            cost[own] = self.cost(codes[own])
            starts = np.cumsum([0] + [s + order for s in sizes[:-1]])
            out[rows] = np.add.reduceat(cost[where], starts)
            n[rows] = sizes
        return n, out


class Model:
    """The shards of a trie, each broadcast."""

    def __init__(self, order: int, shards: list):
        self.order, self.shards = order, shards

    def bits(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and bits of each text."""
        n, out = None, np.zeros(len(texts))
        for shard in self.shards:
            n, more = shard.value.bits(texts, self.order)
            out += more
            if len(self.shards) > 1:
                del shard._value  # read again from its file for the next batch: one shard is held at a time
        return n, out


def build(counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ends: np.ndarray | None = None) -> Shard:
    """counts[o]: byte codes of contexts, symbols and counts at order o; contexts of all suffixes must be there, with all their symbols."""
    kind = np.uint32 if len(counts) <= 4 else np.uint64
    levels: list[Level] = []
    for ctx, sym, n in counts:
        levels.append(Level((ctx.astype(np.uint64) << np.uint64(8) | sym.astype(np.uint64)).astype(kind), n, levels[-1] if levels else None))
    return Shard(levels, ends)


def _shares(sizes: dict[int, int], most: int) -> list[list[int]]:
    """The 256 last bytes of contexts in groups of at most `most` symbols, or of one byte."""
    groups: list[list[int]] = [[]]
    held = 0
    for byte in range(256):
        n = sizes.get(byte, 0)
        if groups[-1] and held + n > most:
            groups.append([])
            held = 0
        groups[-1].append(byte)
        held += n
    return groups


def fit(docs: DataFrame, *, order: int = 3, min_count: int = 2, shard_entries: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts the whole corpus and builds the trie of all contexts; `shard_entries` symbols come to the driver at a time."""
    if not 1 <= order <= 7:
        raise ValueError("order must be 1 to 7")
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    counts = corpus_counts(docs, order, id_col, text_col).checkpoint()
    last = F.pmod("ctx", F.lit(256)).cast("int")
    kept = counts.where((F.col("n") >= min_count) | (F.col("order") == 0))
    sizes = {r["last"]: r["n"] for r in kept.where("order > 0").groupBy(last.alias("last")).agg(F.count("*").alias("n")).collect()}
    shares = _shares(sizes, shard_entries)
    shards = []
    for own in shares:
        rows = (kept if len(shares) == 1 else kept.where((F.col("order") == 0) | last.isin(own))).toArrow()
        o, c, s, n = (rows.column(name).to_numpy().astype(np.int64) for name in ("order", "ctx", "sym", "n"))
        ends = None if len(shares) == 1 else np.isin(np.arange(256), own)
        shards.append(spark.sparkContext.broadcast(build([(c[o == k], s[o == k], n[o == k]) for k in range(order + 1)], ends)))
    return Model(order, shards)


def adaptive_bits(data: bytes, order: int = 3) -> float:
    """Code length of data under a trie that starts empty and learns each byte in all its contexts."""
    trie: dict[bytes, dict[int, int]] = defaultdict(dict)
    bits = 0.0
    padded = b"\xff" * order + data
    for i in range(order, len(padded)):
        s = padded[i]
        bits += symbol_bits(trie, padded[i - order : i], s)
        for k in range(order + 1):
            node = trie[padded[i - k : i]]
            node[s] = node.get(s, 0) + 1
    return bits


def symbol_bits(trie: dict[bytes, dict[int, int]], context: bytes, s: int) -> float:
    """One symbol by walking the trie: escapes with explicit exclusion."""
    bits, excluded = 0.0, set()
    for k in range(len(context), -1, -1):
        node = trie.get(context[len(context) - k :])
        if not node:
            continue
        own = {x: n for x, n in node.items() if x not in excluded}
        total = sum(own.values())
        if s in own:
            return bits + math.log2((total + len(own)) / own[s])
        if own:
            bits += math.log2((total + len(own)) / len(own))
        excluded |= own.keys()
    return bits + math.log2(max(1, 256 - len(excluded)))



def score(docs: DataFrame, model: Model | None = None, *, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, bits, bits_per_byte; pretrained with a model, else adaptive."""
    texts = pick(docs, doc_id=id_col, text=text_col)
    schema = T.StructType([T.StructField("doc_id", column_type(texts, "doc_id")), T.StructField("n_bytes", T.LongType()), T.StructField("bits", T.DoubleType())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            if model is not None:
                n, bits = model.bits(b["text"])
            else:
                raw = [(t or "").encode("utf-8", "replace") for t in b["text"]]
                n, bits = [len(r) for r in raw], [adaptive_bits(r, order) for r in raw]
            yield {"doc_id": b["doc_id"], "n_bytes": n, "bits": bits}

    return map_arrow(texts, run, schema).withColumn("bits_per_byte", F.col("bits") / F.nullif("n_bytes", F.lit(0)))
