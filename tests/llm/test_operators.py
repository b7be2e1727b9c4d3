"""The ten operators on small fixtures: brute force, round trips, held-out accuracy and awkward tables."""

import itertools
import math
import random
import re
from collections import Counter

import base64
import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from quire.llm import chat, chunks, common, decontaminate, jaccard, langid, packing, ppm, quality, queries, toxic, webp, webp_write

TOKENIZER = queries.TOKENIZER
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int, stems=WORDS) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(stems) + r.choice(["", "s", "ing", "ed"]) + str(r.randrange(60)) * (r.random() < 0.5) for _ in range(n))


def docs(spark, rows, extra: bool = True):
    """doc_id and text, with columns whose names an operator might use itself."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'x' AS lang", "1 AS __id", "2 AS __spans", "3 AS __gone", "4 AS key", "5 AS n", "6 AS spans_", "7L AS n_chars") if extra else df


AWKWARD = [(1, None), (2, ""), (None, "some words here"), (3, "word " * 40_000), (4, "!!! ???"), (5, "same text twice over"), (5, "same text twice over"), (None, None)]


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# --- 1


def plain_leaks(text, items, n, least):
    own = decontaminate.words(text or "")
    found = set()
    for item, t in items:
        w = decontaminate.words(t or "")
        if len(w) < least:
            continue
        size = min(n, len(w))
        hit = sorted({p for i in range(len(w) - size + 1) for p in range(len(own) - size + 1) if own[p : p + size] == w[i : i + size]})
        start = end = None
        for p in hit:
            if start is None or p > end:
                if start is not None:
                    found.add((item, start, end))
                start = p
            end = p + size
        if start is not None:
            found.add((item, start, end))
    return found


def test_decontamination_against_brute_force(spark):
    items = [(i, prose(i, 20 + i)) for i in range(6)] + [(6, "Four short words here"), (7, "tiny"), (8, None), (6, "Four short words here")]
    bodies = [prose(100, 50), prose(1, 21) + " tail", "Über: " + items[2][1].upper().replace(" ", ",  ") + " — end", "four short words here, four short words", items[3][1] + " gap " + items[3][1]]
    found = decontaminate.find_leaks(docs(spark, list(enumerate(bodies)) + AWKWARD), spark.createDataFrame(items, "item_id long, text string")).collect()
    for d, body in enumerate(bodies):
        at = decontaminate.words_with_offsets(body)
        want = {(i, at[s][1], at[e - 1][2]) for i, s, e in plain_leaks(body, items, 8, 4)}
        assert {(r["item_id"], r["start"], r["end"]) for r in found if r["doc_id"] == d} == want
    assert not [r for r in found if r["doc_id"] in (0, None)]
    assert bodies[2][next(r["start"] for r in found if r["doc_id"] == 2) :].startswith(items[2][1].upper().split()[0])
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.drop_leaks(docs(spark, list(enumerate(bodies))), bench).collect()] == [0]
    many = decontaminate.find_leaks(docs(spark, list(enumerate(bodies))), bench, max_automaton_chars=2000)
    assert rows_of(many, "doc_id", "item_id", "start") == sorted((tuple((r["doc_id"], r["item_id"], r["start"])) for r in found), key=repr)
    kept = decontaminate.drop_leaks(docs(spark, AWKWARD), bench)
    assert kept.count() == len(AWKWARD) and kept.columns == docs(spark, AWKWARD).columns
    assert decontaminate.find_leaks(docs(spark, []), bench).count() == 0 == decontaminate.find_leaks(docs(spark, [(1, "a b c d")]), bench.where("false")).count()


# --- 2


def test_language_identification(spark):
    train = [("en", f"the house of the {prose(i, 5)} and with that") for i in range(20)] + [("de", f"das haus der {prose(i, 5)} und mit dem straßen") for i in range(20)] + [("fr", f"la maison de {prose(i, 5)} et avec une école") for i in range(20)]
    model = langid.train(train)
    assert [langid.score(t, model)[0] for t in ("with the house", "und das mit", "et la maison", "", "123")] == ["en", "de", "fr", "und", "und"]
    assert langid.score("strassen straßenhaus", model)[0] == "de"  # unseen words, known n-grams
    w = "housen"
    assert w not in model.words
    n = next(n for n in range(5, 0, -1) if any(g in model.grams[n] for g in langid.ngrams(w, n)))
    own = [model.grams[n][g] for g in langid.ngrams(w, n) if g in model.grams[n]]
    assert langid.score("漢字 語 العربية", model) == ("und", 0.0, 3)  # no letter of it is known
    assert model.word(w) == pytest.approx([0.8 ** (6 - n) * sum(x) / len(own) for x in zip(*own)])
    df = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(train)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    out = langid.identify(docs(spark, AWKWARD), langid.fit(df))
    assert out.count() == len(AWKWARD) and out.where("doc_id IN (1, 2, 4) AND lang_id <> 'und'").count() == 0
    assert langid.identify(docs(spark, AWKWARD), langid.fit(df.where("false"))).where("lang_id <> 'und'").count() == 0
    assert langid.identify(docs(spark, []), langid.fit(df)).count() == 0


def plain_language(text, rows, order=5, least=2, backoff=0.8, smooth=0.5):
    """Language of a text by counting in the training rows again for each word."""
    langs = sorted({x for x, _ in rows})
    words = {x: Counter(re.findall(r"[^\W\d_]+", " ".join(t for y, t in rows if y == x).lower())) for x in langs}

    def counted(n):
        if n == 0:
            return words
        return {x: sum((Counter({g: c * k for g, k in Counter(f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)).items()}) if n > 1 else Counter({g: c * k for g, k in Counter(w).items()}) for w, c in words[x].items()), Counter()) for x in langs}

    tables = [counted(n) for n in range(order + 1)]
    known = [{g for x in langs for g in t[x] if sum(t[y][g] for y in langs) >= least} for t in tables]
    log = lambda n, x, g: math.log((tables[n][x][g] + smooth) / (sum(tables[n][x][k] for k in known[n]) + sum(v for k, v in tables[n][x].items() if k not in known[n]) + smooth * (len(known[n]) + 1)))
    found = re.findall(r"[^\W\d_]+", (text or "").lower())
    total, told = dict.fromkeys(langs, 0.0), False
    for w in found:
        if w in known[0]:
            told = True
            for x in langs:
                total[x] += log(0, x, w)
            continue
        for n in range(order, 0, -1):
            own = [g for g in ((f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)) if n > 1 else w) if g in known[n]]
            if own:
                told = True
                for x in langs:
                    total[x] += backoff ** (order + 1 - n) * sum(log(n, x, g) for g in own) / len(own)
                break
    if not told:
        return "und", 0.0, len(found)
    best = sorted(langs, key=lambda x: (-total[x], x))
    return best[0], (total[best[0]] - total[best[1]]) / len(found) if len(best) > 1 else 0.0, len(found)


def test_languages_against_plain_version(spark):
    train = [("en", "the cat sat on the mat and the dog"), ("en", "a cat and a hat"), ("de", "die katze und der hund"), ("de", "der hut und die katze"), ("fr", "le chat et le chien"), ("xx", "tie tie"), ("yy", "tie tie")]
    texts = ["the cat", "katzen und hunde", "chats", "tie", "ties", "zzzz", "漢字", "Der Hut, THE hat 12", "", None, "q"]
    df = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(train)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(docs(spark, list(enumerate(texts))), langid.fit(df)).collect()}
    for i, t in enumerate(texts):
        want = plain_language(t, train)
        assert (got[i]["lang_id"], got[i]["n_words"]) == (want[0], want[2]) and got[i]["margin"] == pytest.approx(want[1])
    assert got[3]["lang_id"] == "xx" and got[3]["margin"] == 0  # a tie goes to the first
    many = spark.createDataFrame([(i, "the common tongue", "en") for i in range(900)] + [(1000 + i, "kaipa harvin", "fi") for i in range(2)], "doc_id long, text string, lang string")
    few = langid.fit(many, max_per_lang=5)
    assert few.langs == ["en", "fi"] and langid.score("harvin", few)[0] == "fi"


# --- 3


def plain_pack(lengths, window, limit):
    """(used, pieces) of one bucket: emitted windows and what is left open."""
    open_, done = [], []
    for doc, n in lengths:
        for s in range(0, n, window):
            size = min(n, s + window) - s
            fit = [w for w in open_ if w[0] + size <= window]
            if fit:
                best = max(fit, key=lambda w: w[0])
            else:
                if len(open_) == limit:
                    full = max(open_, key=lambda w: w[0])
                    open_ = [w for w in open_ if w is not full]
                    done.append(full)
                best = [0, []]
                open_.append(best)
            best[0] += size
            best[1].append((doc, s, s + size))
            if best[0] == window:
                open_ = [w for w in open_ if w is not best]
                done.append(best)
    return done, open_


def test_packing_against_plain_version(spark):
    r = random.Random(4)
    rows = [(i, "x" * r.choice([1, 5, 30, 63, 64, 65, 200])) for i in range(60)]
    got = packing.pack_windows(docs(spark, rows), window=64, open_windows=3).collect()
    done, open_ = plain_pack([(i, len(t) + 1) for i, t in rows], 64, 3)
    rest, left = [], sorted(open_, key=lambda w: -w[0])
    packer = packing.Packer(64, 3)
    for w in left:
        rest += packer.add(w[0], w[1])
    want = done + rest + packer.rest()
    key = lambda ws: sorted((u, tuple(map(tuple, p))) for u, p in ws)
    assert key([(g["used"], [tuple(p) for p in g["pieces"]]) for g in got]) == key([(u, p) for u, p in want])
    assert len({g["window_id"] for g in got}) == len(got)


def test_packing_of_several_buckets(spark):
    r = random.Random(5)
    rows = [(i // 2, "x" * r.choice([1, 5, 30, 30, 63, 64, 65, 200])) for i in range(150)] + [(None, "y" * 9)] * 5 + [(7, "z" * 20)] * 3
    df = docs(spark, rows)
    got = packing.pack_windows(df, window=64, open_windows=3, rows_per_bucket=20, merge_buckets=3).collect()
    buckets = math.ceil(len(rows) / 20)
    at: dict = {}
    for x in df.select("doc_id", (F.length("text") + 1).cast("long").alias("n")).withColumn("b", F.pmod(F.xxhash64("doc_id", "n"), F.lit(buckets))).collect():
        at.setdefault(x["b"], []).append((x["doc_id"], x["n"]))
    want, left = [], {}
    for b in sorted(at):
        done, open_ = plain_pack(sorted(at[b], key=lambda x: (x[0] is None, x[0] or 0, x[1])), 64, 3)
        want += done
        left.setdefault(b // 3, []).extend(open_)
    for own in left.values():
        packer = packing.Packer(64, 3)
        for w in sorted(own, key=lambda w: -w[0]):
            want += packer.add(w[0], w[1])
        want += packer.rest()
    key = lambda ws: sorted((repr((u, [tuple(p) for p in ps])) for u, ps in ws))
    assert len(at) > 3 and key([(g["used"], g["pieces"]) for g in got]) == key(want)
    assert len({g["window_id"] for g in got}) == len(got)


def test_packing_keeps_every_token(spark):
    rows = AWKWARD + [(i, prose(i, 30)) for i in range(10, 40)]
    got = packing.pack_windows(docs(spark, rows), window=256, tokenizer=TOKENIZER, rows_per_bucket=10, merge_buckets=2).collect()
    enc = packing.encoder(TOKENIZER)
    want = Counter()
    for i, t in rows:
        if t:
            want[i] += len(enc.encode_ordinary(t)) + 1
    found = Counter()
    for g in got:
        assert g["used"] == sum(p["end"] - p["start"] for p in g["pieces"]) <= 256
        for p in g["pieces"]:
            found[p["doc_id"]] += p["end"] - p["start"]
    assert found == want
    assert packing.pack_windows(docs(spark, [])).count() == 0 == packing.pack_windows(docs(spark, [(1, None), (2, "")])).count()


# --- 4


def plain_bits(data: bytes, counts: list[dict], order: int) -> float:
    padded, bits = b"\xff" * order + data, 0.0
    trie = {}
    for c in counts:
        trie.update(c)
    for i in range(order, len(padded)):
        bits += ppm.symbol_bits(trie, padded[i - order : i], padded[i])
    return bits


def test_lm_scores_against_walk_of_the_trie(spark):
    texts = [prose(i, 40) for i in range(12)] + ["naïve çà et là " * 5, "zzz"]
    order = 3
    trie: list[dict] = [{} for _ in range(order + 1)]
    for t in texts:
        padded = b"\xff" * order + t.encode()
        for i in range(order, len(padded)):
            for k in range(order + 1):
                node = trie[k].setdefault(padded[i - k : i], {})
                node[padded[i]] = node.get(padded[i], 0) + 1
    total = sum(len(t.encode()) for t in texts)
    kept = [{c: {s: n for s, n in node.items() if n >= 2 or not c} for c, node in level.items() if not c or sum(node.values()) >= 2e-6 * total} for level in trie]
    df = docs(spark, list(enumerate(texts)))
    model = ppm.fit(df)
    got = {r["doc_id"]: r for r in ppm.score(df, model).collect()}
    for i, t in enumerate(texts):
        assert got[i]["bits"] == pytest.approx(plain_bits(t.encode(), kept, order), rel=1e-4)
        assert got[i]["n_bytes"] == len(t.encode())
    unseen = ppm.score(docs(spark, [(1, "Ω≈ç√∫ unlike")]), model).first()
    assert unseen["bits"] == pytest.approx(plain_bits("Ω≈ç√∫ unlike".encode(), kept, order), rel=1e-4)
    assert got[0]["bits_per_byte"] < unseen["bits_per_byte"]


def plain_trie(texts, order):
    trie: list[dict] = [{} for _ in range(order + 1)]
    for t in texts:
        padded = b"\xff" * order + t.encode()
        for k in range(order + 1):
            for g, n in Counter(padded[i - k : i + 1] for i in range(order, len(padded))).items():
                node = trie[k].setdefault(g[:-1], {})
                node[g[-1]] = node.get(g[-1], 0) + n
    return [{c: {s: n for s, n in node.items() if n >= 2 or not c} for c, node in level.items()} for level in trie]


def test_lm_keeps_rare_contexts_of_a_large_corpus(spark):
    texts = ["ab" * 800_000, "ζξψ qwz", "ζξψ qwz", "vkj φχ"]
    df = docs(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r["bits"] for r in ppm.score(df, ppm.fit(df)).collect()}
    trie = plain_trie(texts, 3)
    for i in (1, 2, 3):
        assert got[i] == pytest.approx(plain_bits(texts[i].encode(), trie, 3), rel=1e-4)
    assert got[1] < got[3] / 2


@pytest.mark.parametrize("order, most", [(3, 200), (5, 4_000_000), (6, 300)])
def test_lm_shards_and_longer_contexts(spark, order, most):
    texts = [prose(i, 40) for i in range(12)] + ["naïve çà et là " * 5, "zzz"]
    df = docs(spark, list(enumerate(texts)))
    model = ppm.fit(df, order=order, shard_entries=most)
    assert (len(model.shards) > 1) == (most < 1000)
    got = {r["doc_id"]: r["bits"] for r in ppm.score(df, model).collect()}
    trie = plain_trie(texts, order)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_bits(t.encode(), trie, order), rel=1e-4)


def test_lm_scores_adaptive_and_awkward(spark):
    assert ppm.adaptive_bits(b"ab" * 50) < ppm.adaptive_bits(random.Random(1).randbytes(100))
    assert ppm.adaptive_bits(b"a") == pytest.approx(8)
    model = ppm.fit(docs(spark, AWKWARD))
    out = ppm.score(docs(spark, AWKWARD), model)
    assert out.count() == len(AWKWARD) and out.where("doc_id IN (1, 2) AND (n_bytes <> 0 OR bits <> 0 OR bits_per_byte IS NOT NULL)").count() == 0
    assert ppm.score(docs(spark, [(1, "abc")]), ppm.fit(docs(spark, []))).first()["bits"] == pytest.approx(24)
    assert ppm.score(docs(spark, [(1, "abab"), (2, None)])).where("doc_id = 1").first()["bits"] == pytest.approx(ppm.adaptive_bits(b"abab"))
    assert ppm.score(docs(spark, []), model).count() == 0


# --- 5


def grams(text, n=2):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(tuple(w[i : i + min(n, len(w))]) for i in range(len(w) - min(n, len(w)) + 1)) if w else frozenset()


def altered(text, share, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) if r.random() < share else w for w in text.split())


def near_corpus():
    rows = []
    for i in range(40):
        base = prose(i, random.Random(i).choice([6, 20, 80, 300, 900]))
        rows.append((100 * i + 100, base))
        rows += [(100 * i + 100 + k, altered(base, s, i * 10 + k)) for k, s in enumerate((0.0, 0.02, 0.05, 0.1, 0.2), 1)]
    return rows


def plain_pairs(rows, threshold=0.65):
    sets = [(i, grams(t)) for i, t in rows if i is not None and grams(t)]
    return {(min(a, b), max(a, b)): len(x & y) / len(x | y) for (a, x), (b, y) in itertools.combinations(sets, 2) if a != b and len(x & y) >= threshold * len(x | y)}


def plain_classes(rows):
    """doc_id -> (class_id, links, copies) by comparing all documents; ids with one text only."""
    found = plain_pairs(rows)
    sets = {i: grams(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = {i: set() for i in sets}
    for a, b in found:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
        if sets[a] != sets[b]:
            links[a].add(sets[b])
            links[b].add(sets[a])
    same = Counter(sets.values())
    return {i: (root(i), len(links[i]), same[sets[i]] - 1 if sets[i] else 0) for i in sets}


COPIES = [(7001, "an exact copy of it"), (7000, "an exact copy of it"), (7002, "An exact, copy of it!"), (7003, "an exact copy of it all")]


@pytest.fixture(scope="module")
def near():
    rows = near_corpus() + AWKWARD + COPIES
    return rows, plain_classes(rows), plain_pairs(rows)


@pytest.mark.parametrize("options", [{}, {"parts": None}, {"tile": 7, "hot": 3}])
def test_jaccard_classes_against_brute_force(spark, near, options, monkeypatch):
    rows, want, _ = near
    if "tile" in options:  # blocks of several tiles, signatures in several shares
        monkeypatch.setattr(jaccard, "TILE", options["tile"])
        monkeypatch.setattr(jaccard, "HOT", options["hot"])
        monkeypatch.setattr(jaccard, "FEW", 1)
        options = {}
    got = {r["doc_id"]: (r["class_id"], r["links"], r["copies"]) for r in jaccard.classes(docs(spark, rows), **options).collect()}
    assert got == want


def test_jaccard_pairs_of_texts(spark, near):
    rows, want, pairs = near
    sets = {i: grams(t) for i, t in rows}
    rep = {s: min(i for i in sets if i is not None and sets[i] == s) for s in set(sets.values())}
    got = {(r["rep_a"], r["rep_b"]): r["jaccard"] for r in jaccard.text_pairs(docs(spark, rows)).collect()}
    assert got == {p: pytest.approx(s) for p, s in pairs.items() if sets[p[0]] != sets[p[1]] and all(rep[sets[i]] == i for i in p)}


def test_one_of_each_group_stays(spark, near):
    rows, want, _ = near
    kept = jaccard.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == Counter(i for i, _ in rows if i is None or want[i][0] == i)
    assert jaccard.classes(docs(spark, [])).count() == 0 == jaccard.keep_one(docs(spark, [])).count()
    two = jaccard.classes(docs(spark, [(1, prose(1, 30)), (2, prose(2, 30)), (3, prose(1, 30)), (3, prose(2, 30))]))
    assert rows_of(two, "doc_id", "class_id", "copies") == [(1, 1, 1), (2, 2, 1), (3, 1, 2)]


@pytest.mark.parametrize("m", [5, 30, 80, 95, 120, 200, 310, 1000])
def test_signatures_miss_no_similar_pair(m):
    """Sets of equal and of most unlike sizes, exactly at the threshold: the documented chance of a miss is 3e-5 at most."""
    r, bands = np.random.default_rng(m), jaccard.Bands(0.65)
    new = lambda n: r.integers(0, 2**64, n, dtype=np.uint64)
    for k in range(400):
        if k % 2:
            shared = math.ceil(0.65 * 2 * m / 1.65)
            c = new(shared)
            x, y = (np.unique(np.concatenate((c, new(m - shared)))) for _ in "xy")
        else:
            x = np.unique(new(math.ceil(0.65 * m)))
            y = np.unique(np.concatenate((x, new(m - len(x)))))
        if len(np.intersect1d(x, y)) >= 0.65 * len(np.union1d(x, y)):
            assert len(np.intersect1d(jaccard.signatures(x, bands), jaccard.signatures(y, bands)))
            if k < 20:
                assert len(np.intersect1d(jaccard.signatures(x, bands, None), jaccard.signatures(y, bands, None)))


def test_signatures_and_sketches():
    f = jaccard.features(prose(1, 500), 2)
    bands = jaccard.Bands(0.65)
    assert set(jaccard.signatures(f, bands)) == set(jaccard.signatures(np.sort(f[::-1]), bands))
    for m in range(1, 400):
        n = math.ceil(m * 0.65 - 1e-9)
        assert bands.of(m) - bands.of(n) <= 1
    s = jaccard.sketch(f)
    assert len(s) == 4 and s == jaccard.sketch(f.copy()) and jaccard.sketch(f[:0]) == [0, 0, 0, 0]


# --- 6


def labelled(n=120):
    good = [(100 + i, "The committee reviewed " + prose(i, 60) + " before the meeting ended.", 1) for i in range(n)]
    bad = [(1000 + i, " ".join(w.upper() + "!!! $$$" for w in prose(i, 60).split()), 0) for i in range(n)]
    return good + bad


def test_quality_on_held_out_texts(spark):
    rows = labelled()
    model = quality.train([(y, t) for _, t, y in rows[::2]], size=4096)
    for repeat in (1, 8, 60):  # the score doesn't fade with the length
        right = sum((model.judge(" ".join([t] * repeat))[1] >= 0.5) == bool(y) for _, t, y in rows[1::2])
        assert right >= 0.97 * len(rows[1::2])
    df = docs(spark, [(i, t) for i, t, _ in rows] + AWKWARD)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1, None), (5, 7), (99999, 1)], "doc_id long, quality int")
    fitted = quality.fit(df, labels, size=4096)
    out = quality.classify(df, fitted)
    assert out.count() == df.count() and out.where("doc_id IN (1, 2) AND (score <> 0 OR NOT keep)").count() == 0
    kept = quality.keep_good(df, fitted)
    assert kept.columns == df.columns and rows_of(kept, "doc_id") == rows_of(out.where("keep"), "doc_id")
    one_kind = quality.fit(df, labels.where("quality = 1"))
    assert quality.classify(df, one_kind).where("p_good <> 0.5 OR NOT keep").count() == 0
    assert quality.classify(docs(spark, []), fitted).count() == 0


def test_quality_against_plain_version(spark):
    """The query's rows from the dictionaries and the curve, piece by piece with compressors made anew."""
    rows = [(i, t) for i, t, _ in labelled(30)] + [(1, "short"), (2, "x" * 499 + "é"), (3, prose(1, 700))]
    model = quality.train([(y, t) for _, t, y in labelled()], size=4096)
    for r in quality.classify(docs(spark, rows), model).collect():
        raw = dict(rows)[r["doc_id"]].encode()
        n = max(1, round(len(raw) / 500))
        cuts = [len(raw) * k // n for k in range(n + 1)]
        size = lambda d, p: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False).compress(p))
        score = sum(size(model.bad, raw[a:b]) - size(model.good, raw[a:b]) for a, b in zip(cuts, cuts[1:])) / len(raw)
        short = math.log(min(1, len(raw) / 500))
        x = model.curve[0] * score + model.curve[1] + model.curve[2] * score * short + model.curve[3] * short
        assert r["score"] == pytest.approx(score, abs=2 / len(raw) * n) and r["p_good"] == pytest.approx(1 / (1 + math.exp(-x)), abs=0.3) and r["keep"] == (r["p_good"] >= 0.5)


def test_bounded_samples(spark):
    texts = spark.createDataFrame([(i, "w" * (i + 1)) for i in range(50)] + [(50, "w" * 10_000)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(51)], "doc_id long, label int")
    every = common.labelled_texts(texts, marks, {0: 100, 1: 100}, 10**9)
    assert len(every) == 51 and max(len(t) for _, t in every) == 10_000
    few = common.labelled_texts(texts, marks, {0: 4, 1: 3}, 10**9)
    assert Counter(y for y, _ in few) == {0: 4, 1: 3}
    assert sum(len(t) for _, t in common.labelled_texts(texts, marks, {0: 100, 1: 100}, 300)) <= 300


def test_quality_curve_follows_the_odds():
    rows = [(y, t) for _, t, y in labelled()]
    even, rare = quality.train(rows, size=4096), quality.train(rows, size=4096, odds=9.0)
    assert rare.curve[1] - even.curve[1] == pytest.approx(math.log(9))


# --- 7


def plain_dedup(rows, **o):
    o = {"bits": 4, "least": 16, "most": 512} | o
    parts = {(i, t): chunks.chunk(t, **o) for i, t in rows if i is not None and t}
    first = {}
    for i, t in sorted(parts):
        for d, _, _ in parts[i, t]:
            first.setdefault(d, i)
            first[d] = min(first[d], i)
    out = {}
    for (i, t), cs in parts.items():
        seen, gone = set(), []
        for d, s, e in cs:
            if first[d] < i or d in seen:
                gone.append((s, e))
            seen.add(d)
        runs = []
        for s, e in gone:
            if runs and runs[-1][1] == s:
                runs[-1][1] = e
            else:
                runs.append([s, e])
        runs = [r for r in runs if r[1] - r[0] >= 150]
        at, text = 0, ""
        for s, e in runs:
            text += t[at:s]
            at = e
        out[i, t] = text + t[at:]
    return out


def test_substring_dedup_against_plain_version(spark):
    shared = [prose(900 + k, 70) for k in range(4)]
    rows = [(100 + i, prose(i, 40) + " " + shared[i % 4] + " " + prose(i + 500, 40)) for i in range(24)] + [(150, shared[0] * 3), (151, "ß" * 300 + shared[1]), (152, prose(52, 60))] + AWKWARD
    df = docs(spark, rows)
    out = chunks.dedup(df, spans_col="cut", length_col="n_chars")
    want = plain_dedup(rows)
    assert out.columns == df.columns + ["cut"] and out.count() == len(rows)
    assert rows_of(out, "doc_id", "text") == sorted(((i, want.get((i, t), t)) for i, t in rows), key=repr)
    assert out.where("text IS NOT NULL AND n_chars <> length(text)").count() == 0
    by = {r["doc_id"] - 100: r["text"] for r in out.where("doc_id BETWEEN 100 AND 123").collect()}
    assert all(shared[i % 4][60:-60] not in by[i] for i in range(4, 24)) and all(shared[i] in by[i] for i in range(4))
    assert by[0] == rows[0][1] and chunks.dedup(docs(spark, [])).count() == 0


def test_passages_of_51_words_are_caught(spark):
    """Passages just over 50 words, between texts that no other has: nearly all are cut, by most of their length; no text without one is cut."""
    passages = [prose(3000 + k, 51) for k in range(60)]
    rows = [(k, prose(4000 + k, 60) + " " + p + " " + prose(5000 + k, 60)) for k, p in enumerate(passages)] + [(100 + k, prose(6000 + k, 70) + " " + p + " " + prose(7000 + k, 30)) for k, p in enumerate(passages)] + [(200 + k, prose(8000 + k, 150)) for k in range(60)]
    got = {r["doc_id"]: r["cut"] for r in chunks.dedup(docs(spark, rows), spans_col="cut").collect()}
    shares = [sum(s["end"] - s["start"] for s in got[100 + k]) / len(p) for k, p in enumerate(passages)]
    assert sum(x > 0 for x in shares) >= 58 and sum(shares) / len(shares) > 0.75 and max(shares) <= 1
    assert not any(got[k] for k in [*range(60), *range(200, 260)])


def test_chunks_resist_insertions():
    r = random.Random(2)
    text = prose(7, 3000)
    at = r.randrange(len(text))
    a, b = ({d for d, _, _ in chunks.chunk(t, 4, 16, 512)} for t in (text, text[:at] + "inserted words" + text[at:]))
    assert len(a & b) >= 0.98 * len(a)
    odd = "".join(r.choice("abcé") for _ in range(7)) * 400  # no chunk end by hash in a period: cut at the smallest one, wherever the text starts
    x, y = ({d for d, _, _ in chunks.chunk(t, 12, 24, 512)} for t in (odd, "zz" + odd))
    assert len(x & y) >= len(x) - 3
    for t in (text, odd, "é" * 5000, "a", ""):
        parts = chunks.chunk(t, 4, 16, 512)
        assert "".join(t[s:e] for _, s, e in parts) == t
    raw = np.frombuffer(prose(3, 50).encode(), np.uint8)
    slow, h = [], 0
    for x in raw.tolist():
        h = (2 * h + int(chunks.GEAR[x])) & 0xFFFF
        slow.append(h)
    assert chunks.gear(raw).tolist() == slow


# --- 8


def chain_brute(e, trans):
    """Marginals and log of the sum over all labellings."""
    a = {(0, 0): 0.0, (0, 1): trans[0], (1, 0): trans[1], (1, 1): trans[2]}
    weights = {}
    for y in itertools.product((0, 1), repeat=len(e)):
        weights[y] = math.exp(sum(x for x, k in zip(e, y) if k) + sum(a[p] for p in zip(y, y[1:])))
    z = sum(weights.values())
    return [sum(w for y, w in weights.items() if y[t]) / z for t in range(len(e))], math.log(z)


def test_chain_marginals_and_gradient():
    r = np.random.default_rng(3)
    trans = np.array([-0.7, -0.4, 0.9])
    sizes = [1, 5, 2, 8]
    e = r.normal(0, 2, sum(sizes))
    first = np.cumsum([0] + sizes[:-1])
    a, b = toxic.forward_backward(e, first, np.array(sizes), trans)
    p = 1 / (1 + np.exp(-(a + b)))
    for s, n in zip(first, sizes):
        assert p[s : s + n] == pytest.approx(chain_brute(e[s : s + n], trans)[0])
    for n in (513, 640, 700, 1025):  # long chains go by blocks
        e = r.normal(0, 2, n)
        one, two = toxic.sequential(e, np.array([0]), np.array([n]), trans), toxic._blocked(e, trans)
        assert np.allclose(one[0], two[0]) and np.allclose(one[1], two[1])
    feats = r.integers(0, 6, (2, 8))
    w, y = r.normal(0, 1, 6), np.array([0, 1, 1, 0, 0, 1, 0, 1.0])
    gw, gt = toxic.gradient(feats, np.array([0, 5]), np.array([5, 3]), y, w, trans)

    def likelihood(w, t):
        e = w[feats].sum(0)
        table = {(0, 0): 0.0, (0, 1): t[0], (1, 0): t[1], (1, 1): t[2]}
        total = 0.0
        for s in (slice(0, 5), slice(5, 8)):
            yy = y[s].astype(int)
            total += (e[s] * yy).sum() + sum(table[p] for p in zip(yy.tolist(), yy.tolist()[1:])) - chain_brute(e[s], t)[1]
        return total

    for k in range(6):
        d = np.eye(6)[k] * 1e-5
        assert gw[k] == pytest.approx((likelihood(w + d, trans) - likelihood(w - d, trans)) / 2e-5, abs=1e-4)
    for k in range(3):
        d = np.eye(3)[k] * 1e-5
        assert gt[k] == pytest.approx((likelihood(w, trans + d) - likelihood(w, trans - d)) / 2e-5, abs=1e-4)


def test_toxic_spans_on_held_out_texts(spark):
    r = random.Random(8)
    bad = ["blarg", "snotface", "grumbleheaded"]

    def text(i, k):
        w = prose(i, 60).split()
        for _ in range(k):
            w.insert(r.randrange(len(w)), r.choice(bad))
        return ". ".join(" ".join(w[j : j + 12]) for j in range(0, len(w), 12))

    rows = [(i, text(i, 4 * (i % 3 == 0)), int(i % 3 == 0)) for i in range(240)]
    df = docs(spark, [(i, t) for i, t, _ in rows] + AWKWARD)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:160]] + [(None, 1), (2, None), (77777, 1)], "doc_id long, toxic int")
    model = toxic.fit(df, labels)
    out = {r["doc_id"]: r for r in toxic.tag_documents(df, model).where("doc_id IS NOT NULL").collect()}
    assert sum(out[i]["toxic"] == bool(y) for i, _, y in rows[160:]) >= 76
    found = Counter(t[s["start"] : s["end"]] for i, t, y in rows[160:] if y for s in out[i]["spans"])
    assert sum(found[w] for w in bad) >= 0.9 * sum(found.values()) > 50
    every = toxic.tag_documents(docs(spark, AWKWARD), model)
    assert every.count() == len(AWKWARD) and every.where("doc_id IN (1, 2, 4) AND (score <> 0 OR toxic OR size(spans) > 0)").count() == 0
    assert toxic.fit(df, labels.where("toxic = 0")) is None
    assert toxic.tag_documents(df, None).where("score <> 0 OR toxic").count() == 0
    assert toxic.tag_documents(docs(spark, []), model).count() == 0


def test_toxic_documents_against_every_labelling(spark):
    """Marginals by summing over all labellings of each sentence, then spans and scores word by word."""
    r = random.Random(12)
    bad = ["blarg", "snotface"]
    text = lambda i, k: " ".join(r.choice(bad) if r.random() < k else w for w in prose(i, 7).split())
    train = [(int(i % 2), ". ".join(text(10 * i + j, 0.3 * (i % 2)) for j in range(6))) for i in range(80)]
    model = toxic.train(train)
    rows = [(i, ". ".join(text(9000 + 10 * i + j, 0.2 * (i % 2)) for j in range(3))) for i in range(12)] + [(100, "?! ..."), (101, None)]
    got = {x["doc_id"]: x for x in toxic.tag_documents(docs(spark, rows), model).collect()}
    hits = 0
    for i, t in rows:
        expected, n, spans = 0.0, 0, []
        for m in re.finditer(r"[^.!?\n]+", t or ""):
            words = [(x.start() + m.start(), x.end() + m.start()) for x in re.finditer(r"[^\W\d_]+", m[0])]
            if not words:
                continue
            emission = [sum(float(model.weights[f[k]]) for f in toxic.Tokens([m[0]]).features()) for k in range(len(words))]
            p, _ = chain_brute(emission, model.trans)
            n += len(words)
            expected += sum(x for x in p if x >= 0.1)
            before = False
            for (s, e), x in zip(words, p):
                if x >= 0.5:
                    spans = spans[:-1] + [(spans[-1][0], e)] if before else spans + [(s, e)]
                before = x >= 0.5
        score = 1 / (1 + math.exp(-(model.curve @ [math.log1p(expected), math.log1p(n), 1]))) if n else 0.0
        assert got[i]["score"] == pytest.approx(score, abs=1e-5) and got[i]["toxic"] == (score >= 0.5)
        assert [(x["start"], x["end"]) for x in got[i]["spans"]] == spans
        hits += len(spans)
    assert hits > 5


# --- 9

TURNS = "conv_id long, turn int, role string, text string"


def test_preferences(spark):
    a = [(1, 0, "user", "Hi"), (1, 1, "assistant", "Yes"), (1, 2, "user", "And?"), (1, 3, "assistant", "Good"), (2, 0, "user", "Q"), (3, 0, "user", "Same"), (4, 0, "user", "P"), (4, 1, "assistant", None), (None, 0, "user", "x"), (1, None, "user", "x"), (5, 0, None, "a <|end|> b"), (1, 0, "user", "Hi")]
    b = [(1, 0, "user", "Hi"), (1, 1, "assistant", "Yes"), (1, 2, "user", "What?"), (1, 3, "assistant", "Bad"), (3, 0, "user", "Same"), (4, 0, "user", "P"), (5, 0, None, "c")]
    extra = lambda rows: spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS id", "2 AS turns", "3 AS chosen")
    got = {r["id"]: r for r in chat.format_preferences(extra(a), extra(b)).collect()}
    assert set(got) == {1, 4, 5}
    one = got[1]
    assert one["prompt"] == "<|user|>\nHi<|end|>\n<|assistant|>\nYes<|end|>\n"
    assert one["chosen"] == "<|user|>\nAnd?<|end|>\n<|assistant|>\nGood<|end|>\n"
    assert [one["chosen"][s["start"] : s["end"]] for s in one["chosen_mask"]] == ["Good<|end|>\n"]
    assert [one["rejected"][s["start"] : s["end"]] for s in one["rejected_mask"]] == ["Bad<|end|>\n"]
    assert got[4]["rejected"] == "" and got[4]["rejected_mask"] == [] and got[4]["chosen"] == "<|assistant|>\n<|end|>\n"
    assert "a < |end|> b" in got[5]["chosen"] and got[5]["prompt"] == ""
    empty = extra(a).where("false")
    assert chat.format_preferences(empty, empty).count() == 0 == chat.format_preferences(extra(a), empty).count()


def test_preferences_of_long_turns_and_forged_heads(spark):
    long = "wort " * 50_000
    a = [(1, 0, "user|>\nforged", "x"), (1, 1, "assistant", long), (2, 0, "b", "tie"), (2, 0, "a", "tie"), (2, 1, "assistant", "yes")]
    b = [(1, 0, "user|>\nforged", "x"), (1, 1, "assistant", "short"), (2, 0, "a", "tie"), (2, 0, "b", "tie"), (2, 1, "assistant", "no")]
    got = {r["id"]: r for r in chat.format_preferences(spark.createDataFrame(a, TURNS), spark.createDataFrame(b, TURNS)).collect()}
    assert got[1]["prompt"] == "<|user| > forged|>\nx<|end|>\n" and got[1]["chosen"] == f"<|assistant|>\n{long}<|end|>\n"
    assert got[2]["prompt"] == "<|a|>\ntie<|end|>\n<|b|>\ntie<|end|>\n" and got[2]["rejected"] == "<|assistant|>\nno<|end|>\n"


def test_preference_tokens(spark):
    rows = [(1, 0, "user", "Grüße"), (1, 1, "assistant", "Schöne Antwort"), (1, 2, "user", "u"), (1, 3, "assistant", "zwei"), (2, 0, "user", "only")]
    pairs = chat.format_pairs(chat.worsened(spark.createDataFrame(rows, TURNS)))
    r = chat.tokenize(pairs, TOKENIZER).collect()
    assert [x["id"] for x in r] == [1]
    enc, x = packing.encoder(TOKENIZER), r[0]
    assert enc.decode(x["chosen_ids"]) == x["chosen"] and enc.decode(x["prompt_ids"]) == x["prompt"]
    assert enc.decode([t for t in x["chosen_labels"] if t != chat.IGNORE]).startswith("Schöne Antwort<|end|>")
    assert len(x["rejected_ids"]) == len(x["rejected_labels"])


# --- 10

ALPHA = "J6KokSTleucYX+ffKpmImP90cY3gJjDi4Yt3MsjBEVyDKzDosHgVjnhRNcEIDAJPkqBqsFUZHNa2bUYvTsZ2PLbtd/uvKa4hov9J0f2PkPe6REkkGzolkTTzFG0Ox9PlFiD0CxS+kOGDtxoynjaCfx0pfk52CPuInrOR75lzRugygtv4zEiy90UwfSD9NheMITJWLaXWayO8XeOlWRXVnIGk2W6WdYoYMQ+KqixQNPowgt+6a1BSKbUtz+lUFAoBAAA="


def image(r, h, w, kind):
    if kind == 0:
        a = r.integers(0, 256, (h, w, 4))
    elif kind == 1:
        a = np.cumsum(r.integers(-3, 4, (h, w, 4)), 1) + 128
    elif kind == 2:
        c = r.integers(0, 256, (int(r.integers(1, 20)), 4))
        a = c[r.integers(0, len(c), (h, w))]
    else:
        a = np.tile(r.integers(0, 256, (1, 5, 4)), (h, w // 5 + 1, 1))[:, :w]
    return (a & 255).astype(np.uint8)


def test_webp_round_trips():
    r = np.random.default_rng(1)
    for k in range(150):
        h, w = int(r.integers(1, 40)), int(r.integers(1, 40))
        o = webp_write.Options(int(r.choice([0, 2, 3])), int(r.choice([0, 2, 3])), bool(r.integers(2)), bool(r.integers(2)), int(r.choice([0, 1, 4, 11])), bool(r.integers(2)), int(r.choice([0, 2, 3])))
        a = image(r, h, w, k % 4)
        assert webp.decode(webp_write.encode(a, o, k)) == (w, h, a.tobytes()), o


def test_webp_of_other_writers():
    """A widely published file of one transparent pixel, and the alpha plane (a palette, bundled) of a widely published 16 x 16 logo, put in a file of its own."""
    assert webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")) == (1, 1, bytes(4))
    stream = base64.b64decode(ALPHA)
    body = b"\x2f" + (15 | 15 << 14 | 1 << 28).to_bytes(4, "little") + stream + b"\0" * ((len(stream) + 5) % 2)
    w, h, pixels = webp.decode(b"RIFF" + (len(body) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body)
    green = np.frombuffer(pixels, np.uint8).reshape(h, w, 4)[..., 1]
    assert green[0].tolist() == [0, 0, 0, 0, 175, 237, 255, 255, 255, 247, 146, 11, 3, 0, 0, 0]
    assert green[8].tolist() == [247, 255, 255, 170, 78, 166, 247, 255, 255, 255, 255, 255, 255, 255, 247, 71]
    assert green[15].tolist() == [0, 0, 0, 0, 8, 29, 53, 66, 71, 69, 56, 31, 8, 0, 0, 0]


def test_webp_batches_of_mixed_sizes():
    """Many images in step, large ones and broken ones among them, are what each is by itself."""
    r = np.random.default_rng(5)
    files, want = [], []
    for k in range(130):
        h, w = (int(x) for x in (r.integers(1, 30, 2) if k % 40 else (300, 211)))
        o = webp_write.VARIANTS[k % len(webp_write.VARIANTS)]
        a = image(r, h, w, k % 4)
        files.append(webp_write.encode(a, o, k))
        want.append((w, h, a.tobytes(), None))
        if k % 10 == 3:
            files.append(None if k % 20 == 3 else files[-1][: len(files[-1]) // 2])
            want.append((None, None, None, None))
    for batch in (webp.BATCH, 20_000):
        webp.BATCH, before = batch, webp.BATCH
        got = [x for part in webp.decode_many(files) for x in part]
        webp.BATCH = before
        assert len(got) == len(want) and all(g == x if x[0] or f is None else g[:3] == (None,) * 3 and g[3] for f, g, x in zip(files, got, want))


def test_webp_many_at_once():
    """Images written together are what each is by itself, with few Python calls for each."""
    import cProfile
    import pstats

    r = np.random.default_rng(11)
    for k, o in enumerate(webp_write.VARIANTS):
        images = [image(r, *(int(x) for x in r.integers(1, 40, 2)), n % 4) for n in range(20)]
        assert webp_write.encode_many(images, o, k) == [webp_write.encode(a, o, k) for a in images]
    assert webp_write.encode_many([]) == []
    texts = [prose(i, 300) for i in range(120)]
    with cProfile.Profile() as p:
        files = [f for k, o in enumerate(webp_write.VARIANTS) for f in webp_write.encode_many([webp_write.picture(t, o.palette) for t in texts[k::6]], o, k)]
    assert len(files) == 120 and pstats.Stats(p).total_calls < 1_000 * 120


def test_webp_by_bits():
    """Images read by looking up every bit are what they are symbol by symbol, broken ones too."""
    r = np.random.default_rng(12)
    before = webp.BY_BITS
    used = []
    for k in range(60):
        o = webp_write.Options(int(r.choice([0, 2])), 0, bool(r.integers(2)), k % 3 == 0, int(r.choice([0, 1, 6])), bool(r.integers(2)), 0)
        h, w = (int(x) for x in r.integers(15, 45, 2))
        a = image(r, h, w, k % 4)
        good = webp_write.encode(a, o, k)
        files = [good, good[:-40]]
        for _ in range(8):
            d = bytearray(good)
            d[int(r.integers(25, len(d)))] ^= 1 << int(r.integers(8))
            files.append(bytes(d))
        try:
            webp.BY_BITS = 1, 1 << 30
            got = [x for part in webp.decode_many(files) for x in part]
            webp.BY_BITS = 1 << 60, 0
            want = [x for part in webp.decode_many(files) for x in part]
        finally:
            webp.BY_BITS = before
        assert got[0] == (w, h, a.tobytes(), None) and got[1][3], o
        assert [(x[:3], bool(x[3])) for x in got] == [(x[:3], bool(x[3])) for x in want], o
        used.append(sum(x[3] is None for x in got))
    assert sum(used) > 60  # some broken streams still make an image


def test_webp_tables(spark):
    r = np.random.default_rng(2)
    a = image(r, 6, 7, 1)
    good = webp_write.encode(a, webp_write.Options(predictor=2, cache_bits=3, matches=True))
    rows = [(1, good), (2, None), (3, b""), (4, good[:30]), (5, b"RIFF....WEBPVP8 " + b"\0" * 40), (None, good), (1, good)]
    for _ in range(100):
        d = bytearray(good)
        d[int(r.integers(20, len(d)))] = int(r.integers(256))
        rows.append((6, bytes(d)))
    df = spark.createDataFrame(rows, "image_id long, data binary").selectExpr("*", "1 AS width", "2 AS error")
    out = webp.decode_images(df).collect()
    assert len(out) == len(rows)
    by = {x["image_id"]: x for x in out}
    assert bytes(by[1]["pixels"]) == bytes(by[None]["pixels"]) == a.tobytes() and by[2]["error"] is None and by[2]["pixels"] is None
    assert all(by[k]["error"] and by[k]["pixels"] is None for k in (3, 4, 5))
    assert webp.decode_images(df, max_pixels=5).where("image_id = 1").first()["error"] == "too many pixels"
    assert webp.decode_images(df.where("false")).count() == 0
    pages = spark.createDataFrame([(i, prose(i, 30)) for i in range(12)] + [(12, None), (13, "")], "page_id long, html string")
    made = {x["image_id"]: x for x in webp.decode_images(webp_write.picture_files(pages)).collect()}
    assert made[12]["pixels"] is None and len(made) == 14
    for i in range(12):
        grey = webp_write.VARIANTS[i % 6].palette
        assert bytes(made[i]["pixels"]) == webp_write.picture(prose(i, 30), grey).tobytes()
        body = np.frombuffer(made[i]["pixels"], np.uint8).reshape(-1, 4)[:, : 1 if grey else 3].tobytes()
        assert body.rstrip(b"\0") == prose(i, 30).encode()  # the whole page is in the picture


# --- all


def test_no_local_checkpoint():
    import inspect

    for m in (chat, chunks, common, decontaminate, jaccard, langid, packing, ppm, quality, queries, toxic, webp, webp_write):
        assert "localCheckpoint" not in inspect.getsource(m) and m.__doc__
    assert xxhash.xxh3_64_intdigest(b"") == 0x2D06800538D394C2
