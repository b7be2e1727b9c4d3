"""N-gram Jaccard self join with PartEnum signatures.

A document is the set of its word n-grams (case folded, letters and digits only), as 64-bit hashes. Equal sets
form one text class. Set sizes fall into bands such that similar sets lie in one band or in neighbouring ones; a
set signs for its own band and the next. Of two sets in a pair of bands with Jaccard similarity t or more at most
k elements differ, so if the domain is cut into (k + 1) / 2 parts some part has at most one difference, and if
each part is cut in 4, leaving out the right quarter leaves equal rests. Each (band, part, quarter left out,
rest) is one signature.

With `parts=None` all parts are signed and no similar pair can be missed; a set then has about 3 signatures for
each element. By default sets of up to `whole` parts (some 90 elements) are signed so. Larger ones have
many parts of which a similar pair agrees on a steady share: they sign the first `parts` only, without signatures of
fewer than 2 elements (3 above 64 parts), which say little. Elements fall into parts at random, so the chance that a
pair exactly at the threshold has no common signature is at most 3e-5 for any sizes (0.61 ^ 21 or 0.75 ^ 40), and far
less above the threshold or if both are linked to a third text; tests/llm measures it.

Text classes that share a signature and whose sizes allow it are compared by a sketch first: the smallest hash in
each of 64 ranges, 4 bits of each. Pairs of too many unlike places for any two sets of their sizes go, and pairs that
are 5 deviations below the threshold (one at the threshold is so with a chance of 1e-5 at most, by Serfling's bound). What is left is closed into blocks, and a block is compared exactly
through inverted indexes. Only pairs of different texts are ever looked at; copies are never gathered. A signature of
many classes is worked on in shares, and a block of many classes or elements is cut into tiles, of which each two come
together in one group of rows, so neither is one task's work, and no candidate is cut off. What leaves a signature or a tile is a line
for each class, not one for each pair.

Defined results
  null or empty text, text without words   a class of its own without links
  null doc_id                              in no pair, no row in classes, kept by keep_one
  fewer words than n                       the whole text is the one n-gram
  equal sets                               one class, counted as copies, not as links
  repeated rows of one id                  one document: no pair of an id with itself
  several texts of one id                  the smallest class of them; links are added up
  empty table                              an empty result
  extra columns                            ignored by classes and text_pairs, kept by keep_one
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import column_type, drop_ids, ensure_checkpoint_dir, map_arrow, pick, small

WORD = re.compile(r"[^\W_]+")
CACHE = 100_000
QUARTERS = 4
STEP = 4_000_000
FEW = 8
HOT = 2_000
DEVIATIONS = 5
TILE = 2_000
TILE_ELEMENTS = 4_000_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h


HASHES = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def features(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams."""
    if not text:
        return np.zeros(0, np.uint64)
    found = WORD.findall(text.lower())
    w = np.fromiter((HASHES[x] for x in found), np.uint64, len(found))
    size = min(n, len(w))
    if not size:
        return w
    h = np.zeros(len(w) - size + 1, np.uint64)
    for i in range(size):
        h = mix(h + w[i : len(w) - size + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(h)


def class_key(feats: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh3_64_digest(feats.tobytes()), ">i8")[0])


class Bands:
    """Size bands for a threshold; of(m) is the band of size m, differ(i) the most differences at level i."""

    def __init__(self, threshold: float):
        self.t = threshold
        self.ends = [0]

    def of(self, m: int) -> int:
        while self.ends[-1] < m:
            self.ends.append(int((self.ends[-1] + 1) / self.t + 1e-9))
        return int(np.searchsorted(self.ends, m))

    def differ(self, level: int) -> int:
        while len(self.ends) <= level:
            self.of(self.ends[-1] + 1)
        return int(2 * self.ends[level] * (1 - self.t) / (1 + self.t) + 1e-9)


def _cut(size: int, k: int, parts: int | None, whole: int) -> tuple[int, int, int]:
    """Parts of the domain for sets of up to `size` elements of which k differ, how many are signed, and the fewest elements of a signature."""
    n = (k + 2) // 2
    if parts is None or n <= whole:
        return n, n, 1
    if n <= 64:
        return n, min(n, parts), 2
    n = size // 6
    return n, min(n, parts), 3


def signatures(feats: np.ndarray, bands: Bands, parts: int | None = 40, whole: int = 20) -> np.ndarray:
    """Distinct signatures as int64; feats must be sorted."""
    if not len(feats):
        return np.zeros(0, np.int64)
    own = bands.of(len(feats))
    out = []
    mixed = np.zeros(0, np.uint64)
    for level in (own, own + 1):
        k = bands.differ(level)
        salt = np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)
        if k == 0:
            out.append(mix(np.sum(mix(feats), dtype=np.uint64, keepdims=True) + salt))
            continue
        n, used, least = _cut(bands.ends[level], k, parts, whole)
        edges = np.arange(used * QUARTERS + 1, dtype=np.uint64) * np.uint64(2**32 // (n * QUARTERS)) << np.uint64(32)
        if used == n:
            edges = edges[:-1]
        at = np.searchsorted(feats, edges)
        if used == n:
            at = np.append(at, len(feats))
        if len(mixed) < at[-1]:
            mixed = mix(feats[: at[-1]])
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed[: at[-1]])))[at]
        sums = (total[1:] - total[:-1]).reshape(used, QUARTERS)
        count = np.diff(at).reshape(used, QUARTERS)
        rest = sums.sum(1, dtype=np.uint64)[:, None] - sums
        place = np.arange(used * QUARTERS, dtype=np.uint64).reshape(used, QUARTERS) * np.uint64(0xD6E8FEB86659FD93)
        out.append(mix(mix(rest + salt) + place)[(count.sum(1)[:, None] - count) >= least])
    return np.unique(np.concatenate(out)).view(np.int64)


EDGES = np.arange(64, dtype=np.uint64) << np.uint64(58)
PLACES = np.arange(0, 64, 4, dtype=np.uint64)


def sketch(feats: np.ndarray) -> list[int]:
    """64 values of 4 bits as four numbers: 1 to 15 from the smallest element of each range, 0 where it has none."""
    at = np.searchsorted(feats, EDGES)
    ends = np.append(at[1:], len(feats))
    v = np.zeros(64, np.uint64)
    full = at < ends
    v[full] = mix(feats[at[full]]) % np.uint64(15) + np.uint64(1)
    return np.bitwise_or.reduce(v.reshape(4, 16) << PLACES, 1).view(np.int64).tolist()


def _filled(x: Column) -> Column:
    """How many of the 16 values are not 0."""
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def likely(a: str, b: str, threshold: float) -> Column:
    """Whether sizes and sketches of rows a and b allow the threshold.

    Each place where the sketches are unlike has an element of one set only, of which similar sets have few; and the
    places used are so many elements drawn from the union without replacement, most of which similar sets share.
    """
    sides = [(F.col(f"{a}.s{k}"), F.col(f"{b}.s{k}")) for k in range(4)]
    used = sum(_filled(x.bitwiseOR(y)) for x, y in sides)
    unlike = sum(_filled(x.bitwiseXOR(y)) for x, y in sides)
    n, m = F.col(f"{a}.size"), F.col(f"{b}.size")
    union = (n + m) / (1 + threshold)
    least = used * threshold - DEVIATIONS * F.sqrt(used * threshold * (1 - threshold) * F.greatest(F.lit(0.0), 1 - used / union)) - 0.5
    return (F.least(n, m) >= F.greatest(n, m) * threshold - 1e-6) & (unlike <= union * (1 - threshold) + 1e-6) & (used - unlike >= least)


def components(edges: DataFrame) -> DataFrame:
    """Smallest member `b` of each member `a`'s component, for edges (a, b) with a > b: stars until nothing moves.

    The smallest neighbour comes from a pre-aggregated count by member and a join back, which adaptive execution can
    split where one member has very many neighbours.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = edges.distinct().checkpoint()
    before = None
    while (now := state(edges))[0] and now != before:
        before = now
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().checkpoint()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        stars = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = stars.select("e.a", "e.b").where(F.col("a") > F.col("b")).distinct().checkpoint()
    return edges


def _compare(sets: list[np.ndarray], threshold: float, split: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, js, similarities) for the pairs i < j of sets that reach the threshold; with split, i before it and j from it on."""
    sizes = np.array([len(c) for c in sets])
    whole = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, gram = np.unique(whole, return_inverse=True)
    order = np.argsort(gram, kind="stable")
    post, count = owner[order], np.bincount(gram)
    ends = np.cumsum(count)
    if split:
        begin = ends - np.bincount(gram[sizes[:split].sum() :], minlength=len(count))
    else:
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
    at = 0
    for i, m in enumerate(sizes[:split] if split else sizes):
        own = gram[at : at + m]
        first, last = begin[own] if split else rank[at : at + m] + 1, ends[own]
        at += m
        n = last - first
        total = int(n.sum())
        if not total:
            continue
        shared = np.zeros(len(sets), np.int64)
        bounds = np.searchsorted(np.cumsum(n), np.arange(STEP, total + STEP, STEP)) + 1 if total > STEP else [len(n)]
        low = 0
        for high in bounds:
            f, k = first[low:high], n[low:high]
            where = np.arange(int(k.sum())) + np.repeat(f - np.concatenate(([0], np.cumsum(k)[:-1])), k)
            shared += np.bincount(post[where], minlength=len(sets))
            low = high
        js = np.flatnonzero(shared)
        sim = shared[js] / (m + sizes[js] - shared[js])
        ok = sim >= threshold
        if ok.any():
            yield i, js[ok], sim[ok]


def _alike(sizes: np.ndarray, marks: np.ndarray, i: int, js: np.ndarray, threshold: float) -> np.ndarray:
    """likely() of member i against members js, in numpy; marks has a row of four sketch numbers for each."""

    def filled(x: np.ndarray) -> np.ndarray:
        x = x | x >> np.uint64(1)
        return np.bitwise_count((x | x >> np.uint64(2)) & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64)

    other = marks[js]
    used, unlike = filled(other | marks[i]), filled(other ^ marks[i])
    small_, large = np.minimum(sizes[js], sizes[i]), np.maximum(sizes[js], sizes[i])
    union = (small_ + large) / (1 + threshold)
    least = used * threshold - DEVIATIONS * np.sqrt(used * threshold * (1 - threshold) * np.maximum(0, 1 - used / union)) - 0.5
    return (small_ >= large * threshold - 1e-6) & (unlike <= union * (1 - threshold) + 1e-6) & (used - unlike >= least)


def _stars(keys: np.ndarray, sizes: np.ndarray, marks: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(members, smallest member of the component of each) for the members of one signature that candidate pairs link."""
    by = np.argsort(keys, kind="stable")
    keys, sizes, marks = keys[by], sizes[by], marks[by]
    left = np.arange(len(keys))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    while len(left) > 1:
        first, left = left[0], left[1:]
        wave = [first]
        while wave and len(left):
            hit = _alike(sizes, marks, wave.pop(), left, threshold)
            if hit.any():
                own = left[hit]
                left = left[~hit]
                wave += own.tolist()
                a.append(keys[own])
                b.append(np.full(len(own), keys[first]))
    return (np.concatenate(a), np.concatenate(b)) if a else (keys[:0], keys[:0])


def _candidates(shared: DataFrame, threshold: float) -> DataFrame:
    """Edges a > b whose components are those of all pairs that share a signature and pass likely().

    The pairs of a signature of at most FEW classes are joined. One of more is closed into components where it lies, of
    which only a star of edges is sent; beyond HOT classes it is cut in shares, of which each two come together.
    """
    x, y = (shared.where(F.col("n") <= FEW).alias(c) for c in "xy")
    pairs = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.key") > F.col("y.key"))).where(likely("x", "y", threshold)).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    zero = F.lit(0).cast("long")
    shares = F.ceil(F.col("n") / HOT)
    many = shared.where(F.col("n") > FEW).withColumn("own", F.pmod(F.xxhash64("key"), shares))
    others = F.when(shares == 1, F.array(zero)).otherwise(F.array_remove(F.sequence(zero, shares - 1), F.col("own")))
    many = many.withColumn("other", F.explode(others)).select("sig", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "key", "size", "s0", "s1", "s2", "s3")
    spread = many.repartition("sig", "low", "high").sortWithinPartitions("sig", "low", "high")

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # columns of the signature that the last batch may not have ended

        def told(cols: np.ndarray) -> pa.RecordBatch | None:
            cut = np.flatnonzero((cols[:3, 1:] != cols[:3, :-1]).any(0)) + 1
            found = [_stars(own[3], own[4], np.ascontiguousarray(own[5:].T).view(np.uint64), threshold) for own in np.split(cols, cut, axis=1) if own.shape[1] > 1]
            edges = np.unique(np.concatenate([np.stack(f, 1) for f in found] or [np.zeros((0, 2), np.int64)]), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

        for batch in batches:
            cols = np.stack([batch.column(k).cast(pa.int64()).to_numpy() for k in range(9)])
            whole = np.concatenate([*held, cols], 1)
            last = int(np.flatnonzero((whole[:3] != whole[:3, -1:]).any(0))[-1]) + 1 if (whole[:3] != whole[:3, -1:]).any() else 0
            held = [whole[:, last:]]
            if last:
                yield told(whole[:, :last])
        if held:
            yield told(held[0])

    return pairs.unionAll(spread.mapInArrow(stars, "a long, b long"))


def _signed(docs: DataFrame, n: int, threshold: float, parts: int | None, whole: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Members (key, doc_id), key null without words, and tiles: the texts of the classes to compare (block, low, high, side, key, text)."""
    ensure_checkpoint_dir(docs.sparkSession)
    texts = pick(docs, doc_id=id_col, text=text_col).where(F.col("doc_id").isNotNull())
    long = [T.StructField(f"s{k}", T.LongType()) for k in range(4)]
    schema = T.StructType([T.StructField("doc_id", column_type(texts, "doc_id")), T.StructField("key", T.LongType()), T.StructField("size", T.IntegerType()), *long, T.StructField("sigs", T.ArrayType(T.LongType()))])

    def sign(batches: Iterator[dict]) -> Iterator[dict]:
        bands = Bands(threshold)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                f = features(text, n)
                rows.append((doc, class_key(f), len(f), *sketch(f), signatures(f, bands, parts, whole)) if len(f) else (doc, None, 0, 0, 0, 0, 0, None))
            if rows:
                yield dict(zip(schema.names, zip(*rows)))

    signed = map_arrow(texts, sign, schema).withColumn("row", F.monotonically_increasing_id()).checkpoint()
    info = [F.first(c).alias(c) for c in ("size", *(f.name for f in long))]
    classes = signed.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "row")).alias("rep"), *info).select("key", "rep.*", "size", *(f.name for f in long))
    shared = signed.drop("key").join(small(classes.select("key", "row")), "row").select("key", F.explode("sigs").alias("sig"))
    shared = shared.withColumn("n", F.count("*").over(Window.partitionBy("sig"))).where("n > 1")
    shared = shared.join(classes.drop("doc_id", "row"), "key").checkpoint()
    found = components(_candidates(shared, threshold))
    block = found.select(F.col("a").alias("key"), F.col("b").alias("block")).unionAll(found.select(F.col("b").alias("key"), F.col("b").alias("block")).distinct())
    own = classes.select("key", "doc_id", "size").join(block, "key").checkpoint()
    cuts = own.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("size") / TILE_ELEMENTS)).alias("tiles"))
    own = own.drop("size").join(small(cuts), "block")
    tile = F.pmod(F.xxhash64("key"), F.col("tiles"))
    own = own.withColumn("side", tile).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    own = own.select("block", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "key", "doc_id")
    return signed.select("key", "doc_id").distinct(), texts.join(small(own), "doc_id").select("block", "low", "high", "side", "key", "text")


def _by_tile(linked: DataFrame, n: int, fn, schema: T.StructType) -> DataFrame:
    """fn(keys, sets, split) for each pair of tiles; split is 0 where both are one tile."""
    spread = linked.repartition("block", "low", "high").sortWithinPartitions("block", "low", "high", "side", "key")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        now, sides, sets = None, {}, {}

        def done() -> Iterator[dict]:
            if len(sets) > 1:
                split = sum(s == now[1] for s in sides.values()) if now[1] != now[2] else 0
                if split < len(sets) and (split or now[1] == now[2]):
                    yield from fn(list(sets), list(sets.values()), split)

        for b in batches:
            for block, low, high, side, key, text in zip(*(b[c] for c in ("block", "low", "high", "side", "key", "text"))):
                if (block, low, high) != now:
                    yield from done()
                    now, sides, sets = (block, low, high), {}, {}
                if key not in sets:
                    f = features(text, n)
                    if len(f) and class_key(f) == key:  # another text may bear the same id
                        sets[key], sides[key] = f, side
        yield from done()

    return map_arrow(spread, run, schema)


def text_pairs(docs: DataFrame, *, n: int = 2, threshold: float = 0.65, parts: int | None = 40, whole: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rep_a < rep_b and jaccard for all pairs of different texts of similarity `threshold` or more, each text told by its smallest doc_id."""
    members, linked = _signed(docs, n, threshold, parts, whole, id_col, text_col)
    schema = T.StructType([T.StructField("key_a", T.LongType()), T.StructField("key_b", T.LongType()), T.StructField("jaccard", T.DoubleType())])

    def pairs(keys: list, sets: list[np.ndarray], split: int) -> Iterator[dict]:
        names = np.array(keys, np.int64)
        held: list[tuple] = []
        for i, js, sim in _compare(sets, threshold, split):
            held.append((np.full(len(js), names[i]), names[js], sim))
            if len(held) > 2000:
                yield dict(zip(schema.names, map(np.concatenate, zip(*held))))
                held = []
        if held:
            yield dict(zip(schema.names, map(np.concatenate, zip(*held))))

    reps = members.groupBy("key").agg(F.min("doc_id").alias("rep"))
    near = _by_tile(linked, n, pairs, schema).join(reps.toDF("key_a", "p"), "key_a").join(reps.toDF("key_b", "q"), "key_b").where(F.col("p") != F.col("q"))
    return near.select(F.least("p", "q").alias("rep_a"), F.greatest("p", "q").alias("rep_b"), "jaccard")


def classes(docs: DataFrame, *, n: int = 2, threshold: float = 0.65, parts: int | None = 40, whole: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, links and copies, one row for each document id.

    class_id is the smallest id of all documents that chains of similar pairs link to this one, itself included;
    links counts the different texts of similarity `threshold` or more, copies the other documents of an equal set.
    """
    members, linked = _signed(docs, n, threshold, parts, whole, id_col, text_col)
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("root", T.LongType()), T.StructField("links", T.LongType())])

    def link(keys: list, sets: list[np.ndarray], split: int) -> Iterator[dict]:
        up = list(range(len(keys)))
        links = np.zeros(len(keys), np.int64)

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for i, js, _ in _compare(sets, threshold, split):
            links[i] += len(js)
            links[js] += 1
            for j in js.tolist():
                a, b = root(i), root(j)
                if a != b:
                    if keys[a] < keys[b]:
                        a, b = b, a
                    up[a] = b
        yield {"key": keys, "root": [keys[root(i)] for i in range(len(keys))], "links": links}

    tiles = _by_tile(linked, n, link, schema).checkpoint()
    found = components(tiles.where("key > root").select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = tiles.groupBy("key").agg(F.sum("links").alias("links"))
    per = members.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("low"), (F.count("*") - 1).alias("copies"))
    per = per.join(links, "key", "left").join(found.select(F.col("a").alias("key"), F.col("b").alias("root")), "key", "left")
    per = per.withColumn("root", F.coalesce("root", "key")).checkpoint()
    lowest = per.groupBy("root").agg(F.min("low").alias("class_id"))
    named = per.join(lowest, "root").select("key", "class_id", "links", "copies")
    all_of = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    told = members.join(named, "key", "left").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), all_of("links"), all_of("copies"))
    return told.withColumn("class_id", F.coalesce("class_id", "doc_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without all but the smallest id of each class; all columns are kept."""
    found = classes(docs, id_col=id_col, **options)
    return drop_ids(docs, found.where(F.col("doc_id") > F.col("class_id")).select("doc_id"), id_col)
