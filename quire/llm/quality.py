"""Quality by compression: a zstandard dictionary of good text against one of bad text.

A text is cut into even pieces of about PIECE bytes, which are compressed each by itself with either dictionary, so
that every part of a long text has the dictionaries' help; the difference of the compressed sizes over the size of
the text is its raw score, positive for good text. A logistic curve, fitted on labelled documents that the dictionaries
have not seen, turns it into the probability that the document is good; as the score of less than one piece
says less, the curve has the logarithm of the length below one piece and its product with the score besides.

Defined results
  null or empty text   score 0.0 and probability 0.5: nothing speaks against it, it is kept
  labels with null id or quality, or of documents that are not there   ignored
  labels of one kind only, or none   probability 0.5 for all: everything is kept
  several labels for one id   each counts
  null doc_id, repeated rows   one result row for each input row
  extra columns   ignored by classify, kept by keep_good
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import column_type, labelled_texts, map_arrow, pick, pieces


PIECE = 500


def parts_of(raw: bytes) -> list[bytes]:
    """Even pieces of about PIECE bytes."""
    n = max(1, round(len(raw) / PIECE))
    ends = [len(raw) * i // n for i in range(n + 1)]
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


class Model:
    """curve: weights of the score, of 1, of the score times the log length below one piece, and of that length."""

    def __init__(self, good: bytes, bad: bytes, level: int, curve: list[float]):
        self.good, self.bad, self.level, self.curve = good, bad, level, curve
        self._pair: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def pair(self) -> tuple:
        if self._pair is None:
            made = []
            for raw in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=self.level)
                made.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False))
            self._pair = tuple(made)
        return self._pair

    def score(self, text: str | None) -> float:
        if not text or not self.good:
            return 0.0
        raw = text.encode("utf-8", "replace")
        good, bad = self.pair()
        return sum(len(bad.compress(p)) - len(good.compress(p)) for p in parts_of(raw)) / len(raw)

    def judge(self, text: str | None) -> tuple[float, float]:
        """Score and probability of a text."""
        if not text:
            return 0.0, 0.5
        s = self.score(text)
        x = sum(c * v for c, v in zip(self.curve, terms(s, text)))
        return s, 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def terms(score: float, text: str | None) -> list[float]:
    n = len((text or "").encode("utf-8", "replace"))
    short = math.log(min(n, PIECE) / PIECE) if n else 0.0
    return [score, 1.0, score * short, short]


def dictionary(texts: list[str], size: int) -> bytes:
    """A dictionary trained on the pieces of the texts, or the texts themselves where there are too few to train on."""
    raw = [p for t in texts for p in parts_of(t.encode("utf-8", "replace"))]
    try:
        return zstandard.train_dictionary(size, raw).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(raw)[-size:] + b" " * 8


def calibrate(rows: np.ndarray, labels: np.ndarray, rounds: int = 100) -> list[float]:
    """Weights of a logistic fit by Newton steps on smoothed targets, with a slight pull to 0."""
    pos, neg = int(labels.sum()), int(len(labels) - labels.sum())
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = np.sqrt((rows**2).mean(0)) + 1e-12
    x, w = rows / scale, np.zeros(rows.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (target - p) - 1e-2 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).sum() < 1e-9:
            break
    return (w / scale).tolist()


def train(rows: list[tuple[int, str]], *, size: int = 65_536, level: int = 3, odds: float | None = None) -> Model:
    """rows: (1 good or 0 bad, text). Even rows of either kind train the dictionaries, odd ones the curve, which is then moved to `odds`, good against bad in all labels."""
    kinds = {q: [t for y, t in rows if y == q and t] for q in (0, 1)}
    if min(map(len, kinds.values())) < 2:
        return Model(b"", b"", level, [0.0] * 4)
    model = Model(dictionary(kinds[1][::2], size), dictionary(kinds[0][::2], size), level, [0.0] * 4)
    held = [(q, t) for q in (0, 1) for t in kinds[q][1::2]]
    y = np.array([q for q, _ in held])
    model.curve = calibrate(np.array([terms(model.score(t), t) for _, t in held]), y)
    if odds:
        model.curve[1] += math.log(odds * (y == 0).sum() / y.sum())
    return model


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_per_class: int = 1500, max_train_chars: int = 30_000_000, **options) -> Model:
    """Trains on whole texts of at most `max_per_class` labelled documents of either kind, of `max_train_chars` characters in all; the odds are those of all labels."""
    marks = pick(labels, doc_id=id_col, label=label_col).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    rows = labelled_texts(pick(docs, doc_id=id_col, text=text_col), marks, {0: max_per_class, 1: max_per_class}, max_train_chars)
    n = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    return train(rows, odds=n.get(1, 0) / n[0] if n.get(0) else None, **options)


def classify(docs: DataFrame, model: Model, *, keep_from: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, p_good and keep (p_good >= keep_from) for each row."""
    texts = pick(docs, doc_id=id_col, text=text_col)
    schema = T.StructType([T.StructField("doc_id", column_type(texts, "doc_id")), T.StructField("score", T.DoubleType()), T.StructField("p_good", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        m = shared.value
        for b in batches:
            told = [m.judge(t) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "score": [s for s, _ in told], "p_good": [p for _, p in told], "keep": [p >= keep_from for _, p in told]}

    return map_arrow(texts, run, schema)


def keep_good(docs: DataFrame, model: Model, *, keep_from: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is good enough, with all their columns; one pass, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in (p for batch in batches for p in pieces(batch)):
            yield b.filter(pa.array([m.judge(t)[1] >= keep_from for t in b.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
