"""Toxic spans by a linear-chain conditional random field.

Words are tagged toxic or not. Each has hashed features (the folded word, its beginnings of 3 to 6 letters and its
ending of 3, its case, the words before and after) whose weights add up to an emission; three transition weights
couple neighbours inside a sentence. Forward-backward gives the marginal of each word; runs of words of marginal
`span_from` or more are the offending spans, and a logistic curve over the expected number of toxic words (of marginal
FLOOR or more, so that the many words of a long text that are hardly toxic don't add up) and the length gives the
document score. Feature hashing and the chains are whole-batch numpy: all sentences of a batch
advance in step, the long ones by blocks of 2 x 2 transfer matrices, which gives the same marginals.

Labelled tokens: where only documents are labelled, a word of a toxic document is a toxic token if it, or one of
its beginnings, is found far more often in toxic documents than in others (near copies count once); every word of
a document that is not toxic is a token that is not. The curve is fitted on one half of the sample under a chain
trained on the other; the chain that is used is trained on all of it.

Defined results
  null or empty text, text without letters   score 0.0, not toxic, no spans
  labels with null id or flag, or of documents that are not there   ignored
  labels of one kind only, or none           score 0.0 for all: nothing is toxic
  several labels for one id                  each counts
  null doc_id, repeated rows                 one result row for each input row
  equal marginals                            spans do not depend on ties: each word is decided on its own
  empty table                                an empty result
  extra columns                              ignored, whatever their names
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import column_type, labelled_texts, pick, pieces

BITS = 18
SLICE = 1_500_000
BLOCK = 64
FLOOR = 0.1
HEADS = (3, 4, 5, 6)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
STOPS = "\n.!?…。！？"


class _Tables:
    """Letters, lower case and sentence ends by code point, and powers of the hash base; made once for each process."""

    def __init__(self):
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        for i in np.flatnonzero(self.letter).tolist():
            low = chr(i).lower()
            if len(low) == 1:
                self.lower[i] = ord(low)
        self.stop = np.zeros(0x110000, bool)
        self.stop[[ord(c) for c in STOPS]] = True
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.where(np.arange(size) == 0, np.uint64(1), np.uint64(b)), dtype=np.uint64) for b in (BASE, INVERSE))
        return self.up, self.down


_TABLES: list[_Tables] = []


def tables() -> _Tables:
    if not _TABLES:
        _TABLES.append(_Tables())
    return _TABLES[0]


class Tokens:
    """Words of several texts: row, start and end (in characters of its text), chain bounds and word hashes."""

    def __init__(self, texts: list[str]):
        t = tables()
        raw = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        offset = np.cumsum([0] + [len(x) + 1 for x in texts[:-1]]) if texts else np.zeros(0, np.int64)
        edge = np.diff(np.concatenate(([False], t.letter[raw], [False])).astype(np.int8))
        self.begin, self.finish = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, self.down = t.powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((t.lower[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64, out=self.sums[1:])
        self.row = np.searchsorted(offset, self.begin, "right") - 1
        self.start, self.end = self.begin - offset[self.row], self.finish - offset[self.row]
        stops = np.concatenate(([0], np.cumsum(t.stop[raw])))[self.begin]
        n = len(self.begin)
        self.first = np.flatnonzero(np.concatenate(([True], stops[1:] != stops[:-1]))) if n else np.zeros(0, np.int64)
        self.size = np.diff(np.concatenate((self.first, [n])))
        upper = raw != t.lower[raw]
        ups = np.concatenate(([0], np.cumsum(upper)))
        u, length = ups[self.finish] - ups[self.begin], self.finish - self.begin
        self.case = np.where(u == 0, 0, np.where((u == length) & (length > 1), 2, np.where(upper[self.begin] & (u == 1), 1, 3))).astype(np.uint64)
        self.word = self.part(self.begin, self.finish)

    def part(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Hash of characters s to e, the same wherever they stand."""
        return (self.sums[e] - self.sums[s]) * self.down[s]

    def heads(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for k in HEADS:
            longer = self.finish - self.begin > k
            yield k, longer, self.part(self.begin, np.minimum(self.begin + k, self.finish))

    def features(self) -> Iterator[np.ndarray]:
        """One table index for each word, feature by feature."""
        yield _slot(self.word, 1)
        for k, longer, h in self.heads():
            yield _slot(np.where(longer, h, np.uint64(0)), 10 + k)
        yield _slot(self.part(np.maximum(self.finish - 3, self.begin), self.finish), 2)
        yield _slot(self.case, 3)
        before, after = np.zeros_like(self.word), np.zeros_like(self.word)
        before[1:], after[:-1] = self.word[:-1], self.word[1:]
        before[self.first], after[self.first + self.size - 1] = 1, 1
        yield _slot(before, 4)
        yield _slot(after, 5)


def _slot(h: np.ndarray, salt: int) -> np.ndarray:
    x = (h ^ np.uint64(salt * 0xA24BAED4963EE407 % 2**64)) * np.uint64(0x9FB21C651E98DF25)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(BASE) >> np.uint64(64 - BITS)).astype(np.int64)


def sequential(e: np.ndarray, first: np.ndarray, size: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log ratios of toxic against not, all chains in step."""
    a01, a10, a11 = trans
    a, b = e.copy(), np.zeros_like(e)
    order = np.argsort(-size, kind="stable")
    starts, lengths = first[order], size[order]
    ends = starts + lengths - 1
    live = len(order) - np.searchsorted(lengths[::-1], np.arange(1, (lengths[0] if len(lengths) else 0)), "right")
    for t, k in enumerate(live.tolist(), 1):
        p = starts[:k] + t
        x = a[p - 1]
        a[p] = e[p] + np.logaddexp(a01, x + a11) - np.logaddexp(0, x + a10)
        q = ends[:k] - t
        y = e[q + 1] + b[q + 1]
        b[q] = np.logaddexp(a10, a11 + y) - np.logaddexp(0, a01 + y)
    return a, b


def _blocked(e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long chain: block products first, then the blocks in a row, then all blocks in step."""
    a01, a10, a11 = trans
    n = len(e) // BLOCK
    g = e[: n * BLOCK].reshape(n, BLOCK)
    zero, far = np.zeros(n), np.full(n, -1e30)
    m = [[zero, far], [far, zero]]  # log of the product of the block's matrices, from state i to state j
    for t in range(BLOCK):
        m = [[np.logaddexp(m[i][0], m[i][1] + a10), g[:, t] + np.logaddexp(m[i][0] + a01, m[i][1] + a11)] for i in (0, 1)]
    enter, leave = np.empty(n), np.empty(n + 1)
    tail = e[n * BLOCK :]
    x = None
    for k in range(n):  # ratio before the block; none before the first
        enter[k] = -np.inf if x is None else x
        if x is None:
            x = e[0]
            for t in range(1, BLOCK):
                x = e[t] + np.logaddexp(a01, x + a11) - np.logaddexp(0, x + a10)
        else:
            x = np.logaddexp(m[0][1][k], x + m[1][1][k]) - np.logaddexp(m[0][0][k], x + m[1][0][k])
    a = np.empty(len(e))
    x = enter
    for t in range(BLOCK):
        x = g[:, t] + np.logaddexp(a01, x + a11) - np.logaddexp(0, x + a10)
        if t == 0:
            x[0] = e[0]
        a[np.arange(n) * BLOCK + t] = x
    y = 0.0
    b = np.zeros(len(e))
    at = len(e) - 1
    for t in range(len(tail)):
        if t:
            z = e[at + 1] + b[at + 1]
            b[at] = np.logaddexp(a10, a11 + z) - np.logaddexp(0, a01 + z)
            a_at = at
        at -= 1
    for t in range(len(tail)):
        p = n * BLOCK + t
        a[p] = e[p] + np.logaddexp(a01, a[p - 1] + a11) - np.logaddexp(0, a[p - 1] + a10)
    if len(tail):
        z = e[n * BLOCK] + b[n * BLOCK]
        y = np.logaddexp(a10, a11 + z) - np.logaddexp(0, a01 + z)
    leave[n - 1] = y  # backward ratio at the last word of the block
    for k in range(n - 1, 0, -1):
        y = np.logaddexp(m[1][0][k], m[1][1][k] + y) - np.logaddexp(m[0][0][k], m[0][1][k] + y)
        leave[k - 1] = y
    y = leave[:n]
    for t in range(BLOCK - 1, -1, -1):
        b[np.arange(n) * BLOCK + t] = y
        z = g[:, t] + y
        y = np.logaddexp(a10, a11 + z) - np.logaddexp(0, a01 + z)
    return a, b


def forward_backward(e: np.ndarray, first: np.ndarray, size: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    long = size > 8 * BLOCK
    if not long.any():
        return sequential(e, first, size, trans)
    a, b = sequential(e, first[~long], size[~long], trans)
    for s, n in zip(first[long].tolist(), size[long].tolist()):
        a[s : s + n], b[s : s + n] = _blocked(e[s : s + n], trans)
    return a, b


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Model:
    def __init__(self, weights: np.ndarray, trans: np.ndarray, curve: np.ndarray):
        self.weights, self.trans, self.curve = weights, trans, curve

    def marginals(self, tokens: Tokens) -> np.ndarray:
        e = np.zeros(len(tokens.begin))
        for f in tokens.features():
            e += self.weights[f]
        a, b = forward_backward(e, tokens.first, tokens.size, self.trans)
        return _sigmoid(a + b)

    def scores(self, expected: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = np.stack([np.log1p(expected), np.log1p(n), np.ones(len(n))], 1)
        return np.where(n > 0, _sigmoid(x @ self.curve), 0.0)


def expected_words(tokens: Tokens, p: np.ndarray, rows: int) -> np.ndarray:
    """Sum of the marginals of FLOOR or more of each of so many texts."""
    return np.bincount(tokens.row, np.where(p >= FLOOR, p, 0.0), rows)


def _distinct(texts: list[str]) -> list[str]:
    """Without near copies: those that share two of four minima over their runs of 5 words with an earlier text."""
    kept, seen = [], set()
    for t in texts:
        w = Tokens([t]).word
        h = w[: max(0, len(w) - 4)].copy()
        for k in range(1, 5 if len(h) else 1):
            h = _mix(h * np.uint64(BASE) + w[k : len(h) + k])
        keys = [(k, int(_mix(h ^ np.uint64(k * BASE % 2**64)).min())) for k in range(4)] if len(h) else []
        if len(keys) < 2 or sum(k in seen for k in keys) < 2:
            kept.append(t)
            seen.update(keys)
    return kept


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _groups(texts: list[str], size: int = SLICE) -> Iterator[slice]:
    """Neighbouring texts of about `size` characters together."""
    at = 0
    while at < len(texts):
        stop, n = at, 0
        while stop < len(texts) and (stop == at or n < size):
            n += len(texts[stop])
            stop += 1
        yield slice(at, stop)
        at = stop


def toxic_units(toxic: list[str], clean: list[str], min_docs: int, min_ratio: float) -> np.ndarray:
    """Sorted hashes of the words and beginnings that mark toxic documents."""

    def frequencies(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = []
        for t in texts:
            k = Tokens([t])
            own.append(np.unique(np.concatenate([k.word] + [h[longer] for n, longer, h in k.heads() if n > 3])))
        return np.unique(np.concatenate(own), return_counts=True)

    units, n = frequencies(toxic)
    units, n = units[n >= min_docs], n[n >= min_docs]
    other, m = frequencies(clean)
    at = np.minimum(np.searchsorted(other, units), len(other) - 1)
    seen = np.where(other[at] == units, m[at], 0) if len(other) else np.zeros(len(units))
    return units[n >= min_ratio * len(toxic) / max(1, len(clean)) * (seen + 0.5)]


def label_tokens(tokens: Tokens, units: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """1 for the words of the flagged rows that bear a toxic unit."""

    def within(h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(units, h)
        return np.where(at < len(units), units[np.minimum(at, max(0, len(units) - 1))] == h, False) if len(units) else np.zeros(len(h), bool)

    hit = within(tokens.word)
    for n, longer, h in tokens.heads():
        if n > 3:
            hit |= longer & within(h)
    return (hit & flags[tokens.row]).astype(np.float64)


def gradient(feats: np.ndarray, first: np.ndarray, size: np.ndarray, y: np.ndarray, weights: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log likelihood of the labels y, by weights and by transitions 01, 10, 11; feats has a row for each feature."""
    e = np.zeros(len(y))
    for f in feats:
        e += weights[f]
    a, b = forward_backward(e, first, size, trans)
    miss = y - _sigmoid(a + b)
    gw = np.zeros(len(weights))
    for f in feats:
        gw += np.bincount(f, miss, len(weights))
    inner = np.ones(len(y), bool)
    inner[first] = False
    q = np.flatnonzero(inner)
    p = q - 1
    z = e[q] + b[q]
    logits = np.stack([np.zeros(len(q)), trans[0] + z, a[p] + trans[1], a[p] + trans[2] + z])
    logits -= logits.max(0, initial=-np.inf) if len(q) else 0
    prob = np.exp(logits)
    prob /= prob.sum(0)
    seen = np.array([((y[p] == i) & (y[q] == j)).sum() for i, j in ((0, 1), (1, 0), (1, 1))], float)
    return gw, seen - prob[1:].sum(1)


def _chain(toxic: list[str], clean: list[str], min_docs: int, min_ratio: float, rounds: int, rate: float, decay: float) -> Model:
    """A model without a curve, by Adagrad on the log likelihood of the derived token labels."""
    units = toxic_units(toxic, clean, min_docs, min_ratio)
    texts, flags = toxic + clean, np.arange(len(toxic) + len(clean)) < len(toxic)
    parts = []
    for g in _groups(texts, 400_000):  # only indices are kept, a group's characters go
        k = Tokens(texts[g])
        parts.append((np.stack([f.astype(np.int32) for f in k.features()]), k.first, k.size, label_tokens(k, units, flags[g])))
    w, trans = np.zeros(1 << BITS), np.zeros(3)
    hw, ht = np.full(len(w), 1e-8), np.full(3, 1e-8)
    for _ in range(rounds):
        gw, gt = (sum(x) for x in zip(*(gradient(*p, w, trans) for p in parts)))
        gw -= decay * w
        gt -= decay * trans
        hw += gw * gw
        ht += gt * gt
        w += rate * gw / np.sqrt(hw)
        trans += rate * gt / np.sqrt(ht)
    return Model(w.astype(np.float32), trans, np.zeros(3))


def train(rows: list[tuple[int, str]], *, min_docs: int = 4, min_ratio: float = 25.0, rounds: int = 20, rate: float = 0.5, decay: float = 0.02) -> Model | None:
    """rows: (1 toxic or 0 not, text). None if a kind is missing."""
    toxic, clean = (_distinct([t for y, t in rows if y == k and t]) for k in (1, 0))
    if len(toxic) < 2 or len(clean) < 2:
        return None
    half = _chain(toxic[::2], clean[::2], min_docs, min_ratio, rounds, rate, decay)
    held = toxic[1::2] + clean[1::2]
    expected, n = np.zeros(len(held)), np.zeros(len(held))
    for g in _groups(held, 400_000):
        k = Tokens(held[g])
        expected[g], n[g] = expected_words(k, half.marginals(k), g.stop - g.start), np.bincount(k.row, minlength=g.stop - g.start)
    x = np.stack([np.log1p(expected), np.log1p(n), np.ones(len(n))], 1)
    target = (np.arange(len(held)) < len(toxic[1::2])).astype(float)
    curve = np.zeros(3)
    for _ in range(50):
        p = _sigmoid(x @ curve)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        curve += np.clip(np.linalg.solve(h, x.T @ (target - p) - 1e-2 * curve), -2, 2)
    model = _chain(toxic, clean, min_docs, min_ratio, rounds, rate, decay)
    model.curve = curve
    return model


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = 1000, max_clean: int = 2000, max_train_chars: int = 30_000_000, **options) -> Model | None:
    """Trains on whole texts of at most `max_toxic` and `max_clean` labelled documents, of `max_train_chars` characters in all."""
    marks = pick(labels, doc_id=id_col, label=label_col).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    return train(labelled_texts(pick(docs, doc_id=id_col, text=text_col), marks, {1: max_toxic, 0: max_clean}, max_train_chars), **options)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))


def tag(texts: list[str | None], model: Model | None, span_from: float = 0.5) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Score, expected toxic words and spans of each text."""
    score, total = np.zeros(len(texts)), np.zeros(len(texts))
    rows: list[np.ndarray] = []
    cols: list[tuple] = []
    if model is not None:
        own = [t or "" for t in texts]
        for g in _groups(own):
            at, stop = g.start, g.stop
            k = Tokens(own[g])
            p = model.marginals(k)
            expected, n = expected_words(k, p, stop - at), np.bincount(k.row, minlength=stop - at)
            total[at:stop], score[at:stop] = expected, model.scores(expected, n)
            hit = np.flatnonzero(p >= span_from)
            if len(hit):
                chain = np.repeat(np.arange(len(k.size)), k.size)[hit]
                lead = np.flatnonzero(np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (chain[1:] != chain[:-1]))))
                last = np.concatenate((lead[1:], [len(hit)])) - 1
                rows.append(k.row[hit[lead]] + at)
                cols.append((k.start[hit[lead]], k.end[hit[last]], np.maximum.reduceat(p[hit], lead)))
    where = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    parts = [np.concatenate(x) for x in zip(*cols)] if cols else [np.zeros(0)] * 3
    offsets = np.concatenate(([0], np.cumsum(np.bincount(where, minlength=len(texts))))).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(parts[0].astype(np.int32)), pa.array(parts[1].astype(np.int32)), pa.array(parts[2].astype(np.float64))], ["start", "end", "p"])
    return score, total, pa.ListArray.from_arrays(pa.array(offsets), values)


def tag_documents(docs: DataFrame, model: Model | None, *, toxic_from: float = 0.5, span_from: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, toxic (score >= toxic_from), toxic_words (expected) and spans (start, end, p) for each row."""
    texts = pick(docs, doc_id=id_col, text=text_col)
    schema = T.StructType([T.StructField("doc_id", column_type(texts, "doc_id")), T.StructField("score", T.DoubleType()), T.StructField("toxic", T.BooleanType()), T.StructField("toxic_words", T.DoubleType()), T.StructField("spans", SPANS)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for batch in batches for p in pieces(batch)):
            score, total, spans = tag(b.column(1).to_pylist(), shared.value, span_from)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(score >= toxic_from), pa.array(total), spans], ["doc_id", "score", "toxic", "toxic_words", "spans"])

    return texts.mapInArrow(run, schema)
