"""Benchmark decontamination with one Aho-Corasick automaton.

Questions and answers are normalised (NFKD, combining marks dropped, case folded, everything but letters,
digits and their marks turned into one space) and every window of `n` words becomes a pattern; shorter items
are one pattern, if they have `min_words` words. Each text is normalised the same way and scanned once.
Only texts with a hit pay for the map back to offsets in the original.

Defined results
  null or empty text, text without words   no rows
  null, empty or too short item            never matches
  null doc_id                              rows with a null doc_id
  repeated documents or items              each row counts on its own
  equal items                              a span is reported once for each of them
  empty tables                             an empty result
  extra columns                            ignored, whatever their names
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import column_type, map_arrow, pick, pieces


class _Fold(dict):
    """Translation table filled on demand: what a decomposed character contributes."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        if unicodedata.combining(ch):
            out = ""
        elif ch.isalnum() or unicodedata.category(ch)[0] == "M":
            out = ch.casefold()
        else:
            out = " "
        self[code] = out
        return out


FOLD = _Fold()


def words(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    return text.translate(FOLD).split()


def words_with_offsets(text: str) -> list[tuple[str, int, int]]:
    """The words of words(), each with the range of original characters it came from."""
    found: list[tuple[str, int, int]] = []
    piece, start, end = "", 0, 0
    for i, ch in enumerate(text):
        for c in unicodedata.normalize("NFKD", ch).translate(FOLD):
            if c.isspace():
                if piece:
                    found.append((piece, start, end))
                piece = ""
            else:
                if not piece:
                    start = i
                piece += c
                end = i + 1
    if piece:
        found.append((piece, start, end))
    return found


def patterns(items: list[tuple], n: int, min_words: int) -> tuple[dict[str, list[tuple]], dict]:
    """Pattern -> [(item index, first word, words)], and item index -> (item id, words)."""
    found: dict[str, list[tuple]] = defaultdict(list)
    sizes = {}
    for k, (item, *texts) in enumerate(items):
        for part, text in enumerate(texts):
            w = words(text or "")
            if len(w) < min_words:
                continue
            sizes[k, part] = (item, len(w))
            size = min(n, len(w))
            for i in range(len(w) - size + 1):
                found[" " + " ".join(w[i : i + size]) + " "].append(((k, part), i, size))
    return dict(found), sizes


def spans(hits: list[tuple], sizes: dict) -> list[tuple]:
    """(first doc word, item key, first item word, words) hits -> (item key, first, last + 1, share of the item)."""
    out = []
    by: dict = defaultdict(list)
    for at, key, i, size in hits:
        by[key].append((at, i, size))
    for key, own in by.items():
        own.sort()
        start, end, seen = own[0][0], own[0][0], set()
        for at, i, size in own:
            if at > end:
                out.append((key, start, end, len(seen) / sizes[key][1]))
                start, end, seen = at, at, set()
            end = max(end, at + size)
            seen.update(range(i, i + size))
        out.append((key, start, end, len(seen) / sizes[key][1]))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


_LAST: list = []  # the patterns scanned for last and their automaton; holding both keeps the identity test sound


def _automaton(found: dict[str, list[tuple]]) -> ahocorasick.Automaton:
    if not _LAST or _LAST[0] is not found:
        a = ahocorasick.Automaton()
        for p, where in found.items():
            a.add_word(p, (len(p), where))
        a.make_automaton()
        _LAST[:] = [found, a]
    return _LAST[1]


def leaks(text: str | None, found: dict, sizes: dict, auto: ahocorasick.Automaton) -> list[tuple]:
    """(item id, start, end, words, share of the item) of each shared run of one text."""
    own = words(text) if text else []
    if not own:
        return []
    hits = [(last, length, where) for last, (length, where) in auto.iter(" " + " ".join(own) + " ")]
    if not hits:
        return []
    starts = dict(zip(accumulate((len(w) + 1 for w in own), initial=0), range(len(own))))
    at = words_with_offsets(text)
    placed = [(starts[last - length + 1], *w) for last, length, where in hits for w in where]
    return [(sizes[key][0], at[s][1], at[e - 1][2], e - s, share) for key, s, e, share in spans(placed, sizes)]


def _models(docs: DataFrame, benchmark: DataFrame, n: int, min_words: int, item_col: str, item_text_cols: tuple[str, ...], max_automaton_chars: int) -> list:
    """Broadcast (patterns, sizes), one for each automaton; items are collected only shard by shard."""
    bench = pick(benchmark, item=item_col, **{f"t{i}": c for i, c in enumerate(item_text_cols)})
    length = sum(F.coalesce(F.length(f"t{i}"), F.lit(0)) for i in range(len(item_text_cols)))
    total = bench.select(F.coalesce(F.sum(length), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-total * n // max_automaton_chars))
    out = []
    for shard in range(shards):
        own = bench.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard) if shards > 1 else bench
        out.append(docs.sparkSession.sparkContext.broadcast(patterns([tuple(r) for r in own.collect()], n, min_words)))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, n: int = 8, min_words: int = 4, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_cols: tuple[str, ...] = ("text",), max_automaton_chars: int = 8_000_000) -> DataFrame:
    """Every run of at least `n` words that a document shares with a benchmark item.

    Returns doc_id, item_id, start, end (characters of the original text, end exclusive), n_words and
    item_share (the share of the item's words in the run). The benchmark is broadcast only up to
    `max_automaton_chars` pattern characters (some 400 MB of automaton for each worker); a larger one is scanned in several automata by hash of the item.
    """
    item_type = column_type(benchmark, item_col)
    texts = pick(docs, doc_id=id_col, text=text_col)
    schema = T.StructType([T.StructField("doc_id", column_type(texts, "doc_id")), T.StructField("item_id", item_type), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("item_share", T.DoubleType())])
    result = None
    for model in _models(docs, benchmark, n, min_words, item_col, item_text_cols, max_automaton_chars):

        def scan(batches: Iterator[dict], model=model) -> Iterator[dict]:
            found, sizes = model.value
            if not found:
                return
            auto = _automaton(found)
            for b in batches:
                rows = [(doc, *x) for doc, text in zip(b["doc_id"], b["text"]) for x in leaks(text, found, sizes, auto)]
                if rows:
                    yield dict(zip(schema.names, zip(*rows)))

        part = map_arrow(texts, scan, schema)
        result = part if result is None else result.unionAll(part)
    return result


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, n: int = 8, min_words: int = 4, text_col: str = "text", item_col: str = "item_id", item_text_cols: tuple[str, ...] = ("text",), max_automaton_chars: int = 8_000_000) -> DataFrame:
    """The rows of docs without a leak, with all their columns: each row is decided on its own text, without a join."""
    place = docs.columns.index(text_col)
    for model in _models(docs, benchmark, n, min_words, item_col, item_text_cols, max_automaton_chars):

        def keep(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            found, sizes = model.value
            auto = _automaton(found) if found else None
            for b in (p for batch in batches for p in pieces(batch)):
                yield b if auto is None else b.filter(pa.array([next(auto.iter(" " + " ".join(words(t)) + " "), None) is None if t else True for t in b.column(place).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
