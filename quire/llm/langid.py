"""Language identification by words first, character n-grams second.

A word known from training scores its log frequency in each language. An unseen word backs off to the longest
order, from `max_order` down to 1, of which some n-gram of the marked word is known, and scores the mean log
frequency of those n-grams, weighted by `backoff` for each order given up. n-grams of marks alone say nothing and are
left out. A document's score is the sum over all its words; its language is the best one, ties going to the first in
alphabetical order.

Words of the sampled rows are counted where they lie; only (language, word, count) comes to the driver.

Defined results
  null or empty text, text without letters   lang "und", margin 0.0, n_words 0
  no word and no n-gram of it known          lang "und", margin 0.0
  training rows with null text or language   ignored
  no training rows at all                    every document is "und"
  null doc_id, repeated rows                 one result row for each input row
  extra columns                              ignored, whatever their names
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import column_type, map_arrow, pick, sample_each_by_hash

WORD = re.compile(r"[^\W\d_]+")
CACHE = 500_000


def ngrams(word: str, n: int) -> list[str]:
    """Runs of n characters of the marked word, of its letters only for n = 1."""
    w = f"<{word}>" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Model:
    """Log frequencies by language: words[w] and grams[n][g] are tuples over `langs`; default is empty, for words of which nothing is known."""

    def __init__(self, langs: list[str], words: dict, grams: dict, backoff: float, default: tuple):
        self.langs, self.words, self.grams, self.backoff, self.default = langs, words, grams, backoff, default

    def word(self, w: str) -> tuple:
        known = self.words.get(w)
        if known is not None:
            return known
        weight = 1.0
        for n in sorted(self.grams, reverse=True):
            weight *= self.backoff
            own = [s for g in ngrams(w, n) if (s := self.grams[n].get(g)) is not None]
            if own:
                return tuple(weight * sum(x) / len(own) for x in zip(*own))
        return self.default


def train(rows: list[tuple[str, str]], **options) -> Model:
    """rows: (language, text)."""
    by: dict[str, Counter] = defaultdict(Counter)
    for lang, text in rows:
        by[lang].update(WORD.findall(text.lower()))
    return train_counts(by, **options)


def train_counts(by: dict[str, Counter], *, max_order: int = 5, min_word: int = 2, min_gram: int = 2, backoff: float = 0.8, smoothing: float = 0.5) -> Model:
    """by: how often each language has each word."""
    langs = sorted(by)

    def table(counts: dict[str, Counter], least: int) -> dict[str, tuple]:
        total: Counter = Counter()
        for c in counts.values():
            total.update(c)
        keys = [k for k, v in total.items() if v >= least]
        size = {x: sum(counts[x].values()) + smoothing * (len(keys) + 1) for x in langs}
        return {k: tuple(math.log((counts[x][k] + smoothing) / size[x]) for x in langs) for k in keys}

    grams = {}
    for n in range(1, max_order + 1):
        counts: dict[str, Counter] = {x: Counter() for x in langs}
        for x in langs:
            for w, c in by[x].items():
                for g in ngrams(w, n):
                    counts[x][g] += c
        grams[n] = table(counts, min_gram)
    return Model(langs, table(by, min_word), grams, backoff, ())


class _Scores(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, w: str) -> tuple:
        s = self.model.word(w)
        if len(self) >= CACHE:
            self.clear()
        self[w] = s
        return s


def score(text: str, model: Model, cache: dict | None = None) -> tuple[str, float, int]:
    """Language, margin per word over the second best, number of words."""
    found = WORD.findall(text.lower())
    if not found or not model.langs:
        return "und", 0.0, len(found)
    cache = _Scores(model) if cache is None else cache
    total = [0.0] * len(model.langs)
    told = False
    for w, c in Counter(found).items():
        own = cache[w]
        told = told or bool(own)
        for i, x in enumerate(own):
            total[i] += c * x
    if not told:
        return "und", 0.0, len(found)
    order = sorted(range(len(total)), key=lambda i: (-total[i], i))
    best = order[0]
    margin = (total[best] - total[order[1]]) / len(found) if len(order) > 1 else 0.0
    return model.langs[best], margin, len(found)


_CACHES: dict[int, _Scores] = {}


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_per_lang: int = 1000, **options) -> Model:
    """Trains on whole texts of at most `max_per_lang` labelled rows of each language, drawn by id hash, so that a rare language is in the model too."""
    rows = pick(labelled, doc_id=id_col, text=text_col, lang=lang_col).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    few = sample_each_by_hash(rows, "doc_id", "lang", max_per_lang)
    schema = T.StructType([T.StructField("lang", column_type(few, "lang")), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            own: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(b["lang"], b["text"]):
                own[lang].update(WORD.findall(text.lower()))
            yield {"lang": [x for x in own for _ in own[x]], "word": [w for x in own for w in own[x]], "n": [n for x in own for n in own[x].values()]}

    counts = map_arrow(few.select("lang", "text"), count, schema).groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    by: dict[str, Counter] = defaultdict(Counter)
    for lang, word, n in zip(*(counts.column(c).to_pylist() for c in ("lang", "word", "n"))):
        by[lang][word] = n
    return train_counts(by, **options)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_id, margin, n_words for each row."""
    texts = pick(docs, doc_id=id_col, text=text_col)
    schema = T.StructType([T.StructField("doc_id", column_type(texts, "doc_id")), T.StructField("lang_id", T.StringType()), T.StructField("margin", T.DoubleType()), T.StructField("n_words", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        m = shared.value
        if id(m) not in _CACHES:
            _CACHES.clear()
            _CACHES[id(m)] = _Scores(m)
        cache = _CACHES[id(m)]
        for b in batches:
            rows = [score(t or "", m, cache) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "lang_id": [r[0] for r in rows], "margin": [r[1] for r in rows], "n_words": [r[2] for r in rows]}

    return map_arrow(texts, run, schema)
