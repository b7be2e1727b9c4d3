"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns (role and text equal) is rendered once as the prompt; what follows on either
side is rendered as its completion, with a mask: the character ranges to learn from, which are the texts of the
assistant's turns with their end marks. One grouping by conversation, one join by pair, all in built-in functions;
`tokenize` turns the strings into ids and labels with an offset-exact byte-level BPE where that is wanted.

Defined results
  turns with null id or turn number   ignored
  null role or text                   rendered as an empty string; nulls are equal to each other
  pairs found on one side only, a side without turns   no row
  equal sides                         no row: there is no preference
  one side a prefix of the other      its completion is empty, its mask too
  several turns of one number         ordered by role, then text (nulls first)
  repeated rows                       a turn told twice is one turn
  marks inside a text or role         "<|" is written "< |", in a role "|>" "| >" and a line end a space too, so that none can forge a turn
  empty tables                        an empty result
  extra columns                       ignored, whatever their names
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import map_arrow, pick

END = "<|end|>\n"
IGNORE = -100


def _safe(x: Column) -> Column:
    return F.replace(F.coalesce(x, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(turn: Column) -> Column:
    role = F.translate(F.replace(_safe(turn["role"]), F.lit("|>"), F.lit("| >")), "\n\r", "  ")
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _tail(turn: Column) -> Column:
    return F.concat(_safe(turn["text"]), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _tail(t))), "")


def learned(turns: Column) -> Column:
    """(start, end) of each assistant text with its end mark in render(turns)."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        a = acc["at"] + F.length(_head(t))
        b = a + F.length(_tail(t))
        spans = F.when(t["role"] == "assistant", F.array_append(acc["spans"], F.struct(a.alias("start"), b.alias("end")))).otherwise(acc["spans"])
        return F.struct(b.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def conversations(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id and turns, array of (role, text), one row for each conversation."""
    rows = pick(turns, id=id_col, turn=turn_col, role=role_col, text=text_col).where(F.col("id").isNotNull() & F.col("turn").isNotNull())
    found = F.array_sort(F.collect_set(F.struct("turn", F.struct("role", "text").alias("t"))))
    return rows.groupBy("id").agg(F.transform(found, lambda x: x["t"]).alias("turns"))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """id, prompt, chosen, rejected, chosen_mask, rejected_mask from id, chosen, rejected (arrays of (role, text))."""
    differs = F.zip_with("chosen", "rejected", lambda a, b: ~(F.coalesce(a["role"].eqNullSafe(b["role"]), F.lit(False)) & a["text"].eqNullSafe(b["text"])))
    shared = F.coalesce(F.nullif(F.array_position(differs, True), F.lit(0)) - 1, F.least(F.size("chosen"), F.size("rejected"))).cast("int")
    shared = F.least(shared, F.size("chosen"), F.size("rejected"))
    cut = pairs.where((F.size("chosen") > 0) & (F.size("rejected") > 0)).withColumn("n", shared).where((F.size("chosen") > F.col("n")) | (F.size("rejected") > F.col("n")))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    return cut.select("id", render(F.slice("chosen", F.lit(1), F.col("n"))).alias("prompt"), rest("chosen").alias("c"), rest("rejected").alias("r")).select(
        "id", "prompt", render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"), learned(F.col("c")).alias("chosen_mask"), learned(F.col("r")).alias("rejected_mask")
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame, **columns: str) -> DataFrame:
    """Pairs by id the conversations of two tables of turns and formats them."""
    a = conversations(chosen, **columns).withColumnRenamed("turns", "chosen")
    b = conversations(rejected, **columns).withColumnRenamed("turns", "rejected")
    return format_pairs(a.join(b, "id"))


def worsened(turns: DataFrame, **columns: str) -> DataFrame:
    """id, chosen, rejected for turns without a rejected side.

    chosen ends at the last assistant turn. In rejected the last two assistant turns have changed places; with only
    one assistant turn its text is cut to the first half of its characters. Conversations without one have no pair.
    """
    convs = conversations(turns, **columns)
    said = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    rows = convs.withColumn("said", said).where(F.size("said") > 0).withColumn("last", F.try_element_at("said", F.lit(-1))).withColumn("prior", F.when(F.size("said") > 1, F.try_element_at("said", F.lit(-2))))
    rows = rows.withColumn("chosen", F.slice("turns", F.lit(1), F.col("last") + 1))
    text = lambda i: F.get("chosen", i)["text"]

    def swap(t: Column, i: Column) -> Column:
        other = F.when(F.col("prior").isNull(), F.substr(text(F.col("last")), F.lit(1), F.floor(F.length(text(F.col("last"))) / 2).cast("int"))).otherwise(text(F.col("prior")))
        return F.struct(t["role"].alias("role"), F.when(i == F.col("last"), other).when(i == F.col("prior"), text(F.col("last"))).otherwise(t["text"]).alias("text"))

    return rows.select("id", "chosen", F.transform("chosen", swap).alias("rejected"))


def tokenize(pairs: DataFrame, tokenizer: str) -> DataFrame:
    """Adds prompt_ids and, for either completion, its ids and labels (-100 outside the mask; a token counts if it starts in it)."""
    ids, kind = T.ArrayType(T.IntegerType()), pairs.schema
    schema = T.StructType([*kind, *(T.StructField(c, ids) for c in ("prompt_ids", "chosen_ids", "chosen_labels", "rejected_ids", "rejected_labels"))])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        from quire.llm.packing import encoder

        enc = encoder(tokenizer)
        for b in batches:
            out = dict(b) | {"prompt_ids": [enc.encode_ordinary(p) for p in b["prompt"]]}
            for side in ("chosen", "rejected"):
                out[f"{side}_ids"], out[f"{side}_labels"] = [], []
                for text, mask in zip(b[side], b[f"{side}_mask"]):
                    toks = enc.encode_ordinary(text)
                    starts = enc.decode_with_offsets(toks)[1] if toks else []
                    lows, highs = [m["start"] for m in mask], [m["end"] for m in mask]
                    inside = [(k := bisect.bisect_right(lows, s) - 1) >= 0 and s < highs[k] for s in starts]
                    out[f"{side}_ids"].append(toks)
                    out[f"{side}_labels"].append([t if i else IGNORE for t, i in zip(toks, inside)])
            yield out

    return map_arrow(pairs, run, schema)
