"""Stage 9: what each block and each document can be trusted with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import blocks as B


def plain_quality(t: Column) -> Column:
    """Share of printable characters, less replacement characters; 1 for an empty text."""
    n = F.nullif(F.length(t), F.lit(0))
    broken = F.length(t) - F.length(F.replace(t, F.lit("�"), F.lit("")))
    return F.coalesce(F.try_divide(X.printable(t) + X.spaces(t), n) * (1.0 - F.try_divide(broken, n)), F.lit(1.0))


def scored(confidence: Column, t: Column, method: Column) -> Column:
    """The confidence with measured text quality where none was set, trust by method, and their geometric mean."""
    m = X.lookup(method, X.TRUST, 0.7)
    q = X.let(confidence, lambda c: F.when(c["text_quality"] < 1.0, c["text_quality"]).otherwise(plain_quality(t)))

    def whole(k: Column) -> Column:
        c = k["c"]
        product = k["q"] * k["m"] * c["order_quality"] * c["type_quality"]
        parts = {"text_quality": k["q"], "order_quality": c["order_quality"], "type_quality": c["type_quality"], "method_score": k["m"], "final": F.when(product > 0, F.pow(product, F.lit(0.25))).otherwise(0.0)}
        return F.struct(*(v.alias(n) for n, v in parts.items()))

    return X.let(F.struct(confidence.alias("c"), q.alias("q"), m.alias("m")), whole)


def run(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("confidence", scored(F.col("confidence"), F.coalesce("text", F.lit("")), F.col("extraction_method"))).select(*B.COLUMNS)


def documents(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and confidence: the mean over its blocks, 0 without any."""
    means = blocks.groupBy("doc_id").agg(F.avg("confidence.final").alias("confidence"))
    return ids.select("doc_id").distinct().join(means, "doc_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "green").when(confidence >= 0.6, "yellow").otherwise("red")
