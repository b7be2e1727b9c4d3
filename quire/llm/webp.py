"""Lossless WebP to pixel arrays.

A VP8L stream has transforms first, then prefix codes (one group, or one for each block of an entropy image), then
literals, back-references and colour cache hits. Predictor, cross-colour, subtract-green and palette transforms are
undone in reverse order. Pixels are RGBA bytes, row by row.

The symbols of a stream depend on each other. In images of one group of codes the symbols that would start at each bit
are looked up in numpy first, and only the way from one to the next is left to go; colours from the cache and references
are followed to the literals they come from. This is done from BY_BITS[0] pixels on for streams of at most BY_BITS[1]
bytes, as it takes some 30 bytes a bit. Other images are read symbol by symbol, by tables whose entries hold the part of
the pixel and the bits of a symbol together. Predictions depend on the pixels to the left and above only, so all pixels of equal x + 2 y, of all images of a batch,
are undone at once. Pixels are kept in arrays of 4 bytes each; a batch holds BATCH of them, or one larger image.

Defined results
  null bytes             width, height, pixels and error null
  empty or broken bytes  width, height and pixels null, error says why; other rows are not touched
  lossy or other files   the same: error "not a lossless WebP"
  more than `max_pixels` the same: the header is checked before anything is decoded
  null id, repeated rows one result row for each input row
  empty table            an empty result
  extra columns          ignored, whatever their names
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.llm.common import column_type, pick

_B = np.arange(1 << 16, dtype=np.uint32)
for _k in (1, 2, 4, 8):
    _m = sum(((1 << _k) - 1) << i for i in range(0, 16, 2 * _k))
    _B = (_B >> _k & _m) | (_B & _m) << _k
#: The numbers of n bits in reverse order.
TURNED = [(_B[: 1 << n] >> 16 - n).astype(np.int64) for n in range(16)]
TURNED_LISTS = [x.tolist() for x in TURNED[:8]]
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
OPAQUE = 0xFF000000
BATCH = 4_000_000
BY_BITS = 300, 250_000


def _near() -> list[tuple[int, int]]:
    """The 120 short distances: (dx, dy) by distance from the pixel, the right half plane where dy is 0."""
    rings = "01 10 11 -11 02 20 12 -12 21 -21 22 -22 03 30 13 -13 31 -31 23 -23 32 -32 04 40 14 -14 41 -41 33 -33 24 -24 42 -42 05 34 -34 43 -43 50 15 -15 51 -51 25 -25 52 -52 44 -44 35 -35 53 -53 06 60 16 -16 61 -61 26 -26 62 -62 45 -45 54 -54 36 -36 63 -63 07 70 17 -17 55 -55 71 -71 46 -46 64 -64 27 -27 72 -72 37 -37 73 -73 56 -56 65 -65 80 47 -47 74 -74 81 82 66 -66 83 57 -57 75 -75 84 67 -67 76 -76 85 77 -77 86 87"
    return [(int(p[:-1]), int(p[-1])) for p in rings.split()]


NEAR = _near()
NEAR_AT = np.array([(0, 0), *NEAR], np.int64)


class Bits:
    """Bits of a stream, lowest first; reading past the end is an error."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.count = data, 0, 0, 0

    def fill(self) -> None:
        part = self.data[self.at : self.at + 32]
        self.value |= int.from_bytes(part, "little") << self.count
        self.at += 32
        self.count += 256
        if self.at > len(self.data) + 96:
            raise ValueError("the stream ends too early")

    def place(self) -> int:
        """How many bits were read."""
        return self.at * 8 - self.count

    def seek(self, bit: int) -> None:
        self.at, self.value, self.count = bit >> 3, 0, 0
        self.read(bit & 7)

    def read(self, n: int) -> int:
        if self.count < n:
            self.fill()
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        self.count -= n
        return out


class Code:
    """A prefix code: symbols and their lengths, in the order of the codes; the longest has `bits` bits."""

    def __init__(self, found: list[int]):
        """found: length << 16 | symbol of each symbol used."""
        if not found:
            raise ValueError("an empty prefix code")
        if len(found) == 1:
            self.bits, self.symbols, self.lengths = 0, np.array([found[0] & 0xFFFF]), np.zeros(1, np.int64)
            return
        found.sort()
        of = np.array(found, np.int64)
        self.bits, self.symbols, self.lengths = found[-1] >> 16, of & 0xFFFF, of >> 16
        self.times = 1 << self.bits - self.lengths
        total = int(self.times.sum())
        if total != 1 << self.bits:
            raise ValueError("an incomplete prefix code" if total < 1 << self.bits else "an overfull prefix code")

    @classmethod
    def of(cls, symbols: list[int]) -> Code:
        """The code of one or two symbols of one bit."""
        return cls([1 << 16 | s for s in set(symbols)])

    def array(self, entries: np.ndarray) -> np.ndarray:
        """The entry of the symbol that the next `bits` bits start with, for each of their values."""
        return np.repeat(entries, self.times)[TURNED[self.bits]] if self.bits else entries

    def table(self, entries: np.ndarray) -> list[int]:
        return self.array(entries).tolist()


def small_table(lengths: list[int]) -> tuple[list[int], int]:
    """The table of a code of few symbols and its bits; the same as Code makes, for 19 symbols faster in plain Python."""
    used = sorted(n << 8 | s for s, n in enumerate(lengths) if n)
    if not used:
        raise ValueError("an empty prefix code")
    if len(used) == 1:
        return [(used[0] & 255) << 4], 0
    top = used[-1] >> 8
    table = []
    for x in used:
        table += [(x & 255) << 4 | x >> 8] * (1 << top - (x >> 8))
    if len(table) != 1 << top:
        raise ValueError("an incomplete prefix code" if len(table) < 1 << top else "an overfull prefix code")
    return [table[i] for i in TURNED_LISTS[top]], top


def read_code(b: Bits, size: int) -> Code:
    if b.read(1):
        two, wide = b.read(1), b.read(1)
        symbols = [b.read(8 if wide else 1)]
        if two:
            symbols.append(b.read(8))
        return Code.of(symbols)
    own = [0] * 19
    k = 4 + b.read(4)
    told = b.read(3 * k)
    for m in LENGTH_ORDER[:k]:
        own[m] = told & 7
        told >>= 3
    table, width = small_table(own)
    left = 2 + b.read(2 + 2 * b.read(3)) if b.read(1) else size
    found: list[int] = []
    before = 8
    mask = (1 << width) - 1
    data, at, value, count = b.data, b.at, b.value, b.count
    done = 0
    for _ in range(left):
        if done >= size:
            break
        if count < 32:
            value |= int.from_bytes(data[at : at + 32], "little") << count
            at += 32
            count += 256
            if at > len(data) + 96:
                raise ValueError("the stream ends too early")
        e = table[value & mask]
        n = e & 15
        value >>= n
        count -= n
        n = e >> 4
        if n < 16:
            if n:
                found.append(n << 16 | done)
                before = n
            done += 1
            continue
        bits, least = (2, 3) if n == 16 else (3, 3) if n == 17 else (7, 11)
        times = least + (value & (1 << bits) - 1)
        value >>= bits
        count -= bits
        if n == 16:
            found += range(before << 16 | done, (before << 16 | done) + times)
        done += times
    b.at, b.value, b.count = at, value, count
    if done > size:
        raise ValueError("too many code lengths")
    return Code(found)


class Plan:
    """What precedes the symbols of an entropy-coded image."""

    def __init__(self, b: Bits, width: int, height: int, top: bool):
        self.width, self.total = width, width * height
        self.cache_bits = b.read(4) if b.read(1) else 0
        if self.cache_bits > 11:
            raise ValueError("a colour cache of too many bits")
        self.blocks: np.ndarray | None = None
        self.shift = self.across = 0
        groups = 1
        if top and b.read(1):
            self.shift = b.read(3) + 2
            self.across = -(-width >> self.shift)
            self.blocks = (read_pixels(b, self.across, -(-height >> self.shift), False) >> 8 & 0xFFFF).astype(np.int64)
            groups = int(self.blocks.max()) + 1
        green = 280 + (1 << self.cache_bits if self.cache_bits else 0)
        self.codes = [tuple(read_code(b, n) for n in (green, 256, 256, 256, 40)) for _ in range(groups)]


    def tables(self, k: int) -> tuple:
        """Tables and masks of group k. An entry is what its symbol adds to the pixel << 6 | length; -symbol << 6 | length for greens from 256 on."""
        green, red, blue, alpha, far = self.codes[k]
        fixed = 0  # what codes of one symbol add
        parts = []
        for c, up in ((red, 16), (blue, 0), (alpha, 24)):
            if c.bits:
                parts.append((c.table(c.symbols << up + 6 | c.lengths), (1 << c.bits) - 1))
            else:
                fixed |= int(c.symbols[0]) << up
                parts.append(([0], 0))
        entries = np.where(green.symbols < 256, (green.symbols << 8 | fixed) << 6, -green.symbols << 6) | green.lengths
        (rt, rm), (bt, bm), (at, am) = parts
        return green.table(entries), (1 << green.bits) - 1, rt, rm, bt, bm, at, am, far.table(far.symbols << 6 | far.lengths), (1 << far.bits) - 1, not (rm or bm or am)


def _counted(s: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances of prefix symbols, from the bits after them, and how many of these they take."""
    n = np.maximum(0, s - 2 >> 1)
    return np.where(s < 4, s, (2 + (s & 1) << n) + (w & (1 << n) - 1)) + 1, n


def _places(p: np.ndarray, bits: int) -> np.ndarray:
    """Where colours stand in the cache."""
    return (p.astype(np.int64) * 0x1E35A7BD & 0xFFFFFFFF) >> 32 - bits


def _ends(source: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where the way from pixel to source ends for each of the rows, all of which stand after their sources."""
    source = source.copy()
    now = source[rows]
    while True:
        then = source[now]
        if (then == now).all():
            return now
        source[rows] = now = then


def by_bits(plan: Plan, b: Bits) -> np.ndarray | None:
    """The pixels of an image of one group; None, and nothing is read, if it is too large or its cache takes too many rounds."""
    green, red, blue, alpha, far = plan.codes[0]
    total, start = plan.total, b.place()
    data = b.data[start >> 3 : (start >> 3) + 8 * total + 8]
    if len(data) > BY_BITS[1]:
        return None
    raw = np.frombuffer(data + bytes(32), np.uint8)
    size = len(data) + 8
    three = raw[:size] | raw[1 : size + 1].astype(np.int64) << 8 | raw[2 : size + 2].astype(np.int64) << 16
    top = max(c.bits for c in plan.codes[0][:4])
    here = np.empty((size, 8), np.int64)  # the next bits from each bit on
    for k in range(8):
        np.right_shift(three, k, out=here[:, k])
    here &= (1 << top) - 1
    here = here.ravel()

    def full(c: Code, entries: np.ndarray) -> np.ndarray:
        return np.tile(c.array(entries), 1 << top - c.bits)

    symbols = full(green, green.symbols)
    steps = full(green, (green.lengths | (green.symbols >= 256) << 7).astype(np.uint8)).take(here, mode="clip")  # 128 on: no literal
    jumps = np.flatnonzero(steps >= 128)
    s = symbols[here[jumps]]
    jumps, s = jumps[s < 280], s[s < 280]
    if len(jumps):
        at = jumps + (steps[jumps] & 127)
        wide = np.ndarray(size + 9, "<u8", raw, 0, (1,))  # the 8 bytes from each byte on
        w = (wide[at >> 3] >> (at & 7).astype(np.uint64)).view(np.int64)
        length, n = _counted(s - 256, w)
        w >>= n
        f = far.array(far.symbols << 4 | far.lengths)[w & (1 << far.bits) - 1]
        back, m = _counted(f >> 4, w >> (f & 15))
        steps[jumps] += (n + (f & 15) + m).astype(np.uint8)
    others = [(c, up, full(c, c.lengths.astype(np.uint8)).take(here, mode="clip")) for c, up in ((red, 16), (blue, 0), (alpha, 24)) if c.bits]
    on = bytearray(len(steps))
    at, end = start & 7, 8 * len(data)
    if others:
        way, ways = steps.tobytes(), [x.tobytes() for _, _, x in others]
        one, two, more = ways[0], ways[1] if len(ways) > 1 else None, ways[2] if len(ways) > 2 else None
        while at < end:
            on[at] = 1
            k = way[at]
            at += k
            if k > 127:
                at -= 128
                continue
            at += one[at]
            if two:
                at += two[at]
                if more:
                    at += more[at]
        tokens = np.flatnonzero(np.frombuffer(on, bool))
    else:
        alone = steps & 127
        every = np.arange(len(alone))
        pair = alone + alone.take(every + alone, mode="clip")
        four = pair + pair.take(every + pair, mode="clip")  # four symbols at a time
        way = four.tobytes()
        while at < end:
            on[at] = 1
            at += way[at]
        at = np.flatnonzero(np.frombuffer(on, bool))
        at = np.stack((at, at + pair[at]), 1).ravel()
        at = at[at < end]
        tokens = np.stack((at, at + alone[at]), 1).ravel()
        tokens = tokens[tokens < end]
    s = symbols[here[tokens]]
    times = np.ones(len(tokens), np.int64)
    ref = np.flatnonzero((s >= 256) & (s < 280))
    if len(ref):
        which = np.searchsorted(jumps, tokens[ref])
        times[ref] = length[which]
    ends = np.cumsum(times)
    last = int(np.searchsorted(ends, total))
    if last == len(ends):
        raise ValueError("the stream ends too early")
    if ends[last] != total:
        raise ValueError("a reference outside of the image")
    s, times, ends, ref = s[: last + 1], times[: last + 1], ends[: last + 1], ref[ref <= last]
    places = ends - times
    lit, hit = np.flatnonzero(s < 256), np.flatnonzero(s >= 280)
    at = tokens[lit]
    value = s[lit] << 8
    at += steps[at]
    for c, up, x in others:
        value |= full(c, c.symbols)[here[at]] << up
        at += x[at]
    for c, up in ((red, 16), (blue, 0), (alpha, 24)):
        if not c.bits:
            value |= int(c.symbols[0]) << up
    out = np.zeros(total + 1, np.uint32)  # the last one for what is not in the cache yet
    out[places[lit]] = value
    source = np.arange(total + 1)
    if len(ref):
        d, m = back[which[: len(ref)]], times[ref]
        near = NEAR_AT[np.minimum(d, 120)]
        d = np.where(d > 120, d - 120, np.maximum(1, near[:, 0] + near[:, 1] * plan.width))
        if (d > places[ref]).any():
            raise ValueError("a reference outside of the image")
        inside = np.repeat(places[ref] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
        source[inside] -= np.repeat(d, m)
        rest = inside
    if len(hit):
        wanted, asks = s[hit] - 280, places[hit]
        rest = np.concatenate((asks, inside)) if len(ref) else asks
        place = np.full(total, -1)
        place[places[lit]] = _places(value, plan.cache_bits)
        place[asks] = wanted
        # Places of copies are known once their sources are: where they stay the same, all before is right, and so is all
        for _ in range(50):
            known = np.flatnonzero(place >= 0)
            key = np.sort(place[known] * total + known)
            j = key[np.maximum(np.searchsorted(key, wanted * total + asks) - 1, 0)]
            source[asks] = np.where((j // total == wanted) & (j % total < asks), j % total, total)
            out[rest] = out[_ends(source, rest)]
            now = _places(out[rest], plan.cache_bits)
            if (now == place[rest]).all():
                break
            place[rest] = now
        else:
            return None
    elif len(ref):
        out[rest] = out[_ends(source, rest)]
    b.seek((start & ~7) + (int(at[-1]) if s[last] < 256 else int(tokens[last]) + (int(steps[tokens[last]]) & 127)))
    return out[:total]


def read_pixels(b: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """ARGB values of an entropy-coded image."""
    plan = Plan(b, width, height, top)
    total, shift, across = plan.total, plan.shift, plan.across
    if plan.blocks is None and total >= BY_BITS[0] and plan.codes[0][0].bits:
        found = by_bits(plan, b)
        if found is not None:
            return found
    blocks = [] if plan.blocks is None else plan.blocks.tolist()
    cache = [0] * (1 << plan.cache_bits) if plan.cache_bits else []
    down = 32 - plan.cache_bits
    out = array("I")
    append = out.append
    groups: dict[int, tuple] = {}
    here = done = n = stop = 0  # done: pixels already in the cache; stop: where the group may change
    data, at, value, count = b.data, b.at, b.value, b.count
    limit = len(data) + 96
    if not blocks:
        stop = total
        gt, gm, rt, rm, bt, bm, xt, xm, dt, dm, alone = plan.tables(0)
    while n < total:
        if n >= stop:
            y, x = divmod(n, width)
            here = blocks[(y >> shift) * across + (x >> shift)]
            if here not in groups:
                groups[here] = plan.tables(here)
            gt, gm, rt, rm, bt, bm, xt, xm, dt, dm, alone = groups[here]
            stop = n - x + min(width, (x >> shift) + 1 << shift)
        if alone:
            while n < stop:
                if count < 64:
                    value |= int.from_bytes(data[at : at + 32], "little") << count
                    at += 32
                    count += 256
                    if at > limit:
                        raise ValueError("the stream ends too early")
                e = gt[value & gm]
                k = e & 63
                value >>= k
                count -= k
                if e < 0:
                    break
                append(e >> 6)
                n += 1
            else:
                continue
        else:
            while n < stop:
                if count < 64:
                    value |= int.from_bytes(data[at : at + 32], "little") << count
                    at += 32
                    count += 256
                    if at > limit:
                        raise ValueError("the stream ends too early")
                e = gt[value & gm]
                value >>= e & 63
                if e < 0:
                    count -= e & 63
                    break
                f = rt[value & rm]
                value >>= f & 63
                g = bt[value & bm]
                value >>= g & 63
                e += f + g
                if xm:
                    f = xt[value & xm]
                    value >>= f & 63
                    e += f
                count -= e & 63
                append(e >> 6)
                n += 1
            else:
                continue
        s = -(e >> 6)
        if s < 280:
            if count < 64:
                value |= int.from_bytes(data[at : at + 32], "little") << count
                at += 32
                count += 256
                if at > limit:
                    raise ValueError("the stream ends too early")
            s -= 256
            if s < 4:
                length = s + 1
            else:
                k = s - 2 >> 1
                length = (2 + (s & 1) << k) + (value & (1 << k) - 1) + 1
                value >>= k
                count -= k
            e = dt[value & dm]
            k = e & 63
            value >>= k
            count -= k
            s = e >> 6
            if s < 4:
                d = s + 1
            else:
                k = s - 2 >> 1
                d = (2 + (s & 1) << k) + (value & (1 << k) - 1) + 1
                value >>= k
                count -= k
            if d > 120:
                d -= 120
            else:
                dx, dy = NEAR[d - 1]
                d = max(1, dx + dy * width)
            if d > n or length > total - n:
                raise ValueError("a reference outside of the image")
            if d >= length:
                out += out[n - d : n - d + length]
            else:
                part = out[n - d :]
                out += (part * (length // d + 1))[:length]
            n += length
        else:
            for p in out[done:]:
                cache[(p * 0x1E35A7BD & 0xFFFFFFFF) >> down] = p
            done = n
            if s - 280 >= len(cache):
                raise ValueError("a symbol outside of the colour cache")
            append(cache[s - 280])
            n += 1
    b.at, b.value, b.count = at, value, count
    return np.frombuffer(out, np.uint32) if out else np.zeros(0, np.uint32)


def _half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a & b) + (((a ^ b) & 0xFEFEFEFE) >> 1)


def _add(a: np.ndarray, b) -> np.ndarray:
    return (a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00 | (a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF


def _channels(p: np.ndarray) -> np.ndarray:
    return p[:, None] >> np.array([24, 16, 8, 0], np.uint32) & 255


def _select(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    a, t, c = (_channels(x).astype(np.int32) for x in (left, up, corner))
    return np.where(np.abs(t - c).sum(1) < np.abs(a - c).sum(1), left, up)


def _join(values: np.ndarray) -> np.ndarray:
    v = np.clip(values, 0, 255).astype(np.uint32)
    return v[:, 0] << 24 | v[:, 1] << 16 | v[:, 2] << 8 | v[:, 3]


def _full(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    a, t, c = (_channels(x).astype(np.int32) for x in (left, up, corner))
    return _join(a + t - c)


def _step(mean: np.ndarray, corner: np.ndarray) -> np.ndarray:
    m, c = (_channels(x).astype(np.int32) for x in (mean, corner))
    d = m - c
    return _join(m + np.sign(d) * (np.abs(d) >> 1))


#: By mode, from the pixels, the places to predict and those above them.
PREDICT = (
    lambda p, j, u: OPAQUE,
    lambda p, j, u: p[j - 1],
    lambda p, j, u: p[u],
    lambda p, j, u: p[u + 1],
    lambda p, j, u: p[u - 1],
    lambda p, j, u: _half(_half(p[j - 1], p[u + 1]), p[u]),
    lambda p, j, u: _half(p[j - 1], p[u - 1]),
    lambda p, j, u: _half(p[j - 1], p[u]),
    lambda p, j, u: _half(p[u - 1], p[u]),
    lambda p, j, u: _half(p[u], p[u + 1]),
    lambda p, j, u: _half(_half(p[j - 1], p[u - 1]), _half(p[u], p[u + 1])),
    lambda p, j, u: _select(p[j - 1], p[u], p[u - 1]),
    lambda p, j, u: _full(p[j - 1], p[u], p[u - 1]),
    lambda p, j, u: _step(_half(p[j - 1], p[u]), p[u - 1]),
    lambda p, j, u: OPAQUE,
    lambda p, j, u: OPAQUE,
)


def unpredict(jobs: list[tuple[np.ndarray, int, np.ndarray, int]]) -> list[np.ndarray]:
    """Adds the prediction of each pixel: (pixels, width, modes by block, block shift) of several images at once."""
    pad = max(w for _, w, _, _ in jobs) + 1
    pixels = np.concatenate([np.zeros(pad, np.uint32), *(p for p, *_ in jobs)])
    starts = pad + np.cumsum([0] + [len(p) for p, *_ in jobs])
    keys, widths = [], []
    for p, w, modes, shift in jobs:
        h = len(p) // w
        mode = _spread(modes, w, h, shift).reshape(h, w) >> 8 & 15
        mode[0, 1:], mode[1:, 0], mode[0, 0] = 1, 2, 0
        keys.append((((np.arange(w) + 2 * np.arange(h)[:, None]) << 4) + mode).ravel())
        widths.append(np.full(len(p), w))
    key, width = np.concatenate(keys), np.concatenate(widths)
    order = np.argsort(key.astype(np.uint16) if key.max() < 1 << 16 else key, kind="stable")
    key = key[order]
    at = order + pad
    above = at - width[order]
    cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])).tolist()
    for s, e in zip(cuts, cuts[1:]):
        j = at[s:e]
        pixels[j] = _add(pixels[j], PREDICT[int(key[s]) & 15](pixels, j, above[s:e]))
    return [pixels[a:b] for a, b in zip(starts, starts[1:])]


def _spread(blocks: np.ndarray, width: int, height: int, shift: int) -> np.ndarray:
    across = -(-width >> shift)
    b = blocks.reshape(-1, across)
    return np.repeat(np.repeat(b, 1 << shift, 0)[:height], 1 << shift, 1)[:, :width].ravel()


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & 255).astype(np.uint8).view(np.int8).astype(np.int32)


def uncross(p: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    green = _signed(p >> 8)
    red = ((p >> 16 & 255).astype(np.int32) + (_signed(blocks) * green >> 5)) & 255
    blue = ((p & 255).astype(np.int32) + (_signed(blocks >> 8) * green >> 5) + (_signed(blocks >> 16) * _signed(red) >> 5)) & 255
    return p & 0xFF00FF00 | red.astype(np.uint32) << 16 | blue.astype(np.uint32)


def unsubtract(p: np.ndarray) -> np.ndarray:
    green = p >> 8 & 255
    return p & 0xFF00FF00 | ((p >> 16) + green & 255) << 16 | (p + green & 255)


def unindex(p: np.ndarray, packed: int, width: int, height: int, colours: np.ndarray, bundle: int) -> np.ndarray:
    green = (p >> 8 & 255).reshape(height, packed)
    if bundle:
        bits = 8 >> bundle
        green = (green[:, :, None] >> (np.arange(1 << bundle, dtype=np.uint32) * bits) & ((1 << bits) - 1)).reshape(height, -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(colours)] = colours
    return table[green].ravel()


def size_of(data: bytes) -> tuple[int, int, int]:
    """Width, height and the place of the first bit after the header."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a lossless WebP")
    at = 12
    while at + 8 <= len(data) and data[at : at + 4] != b"VP8L":
        at += 8 + (int.from_bytes(data[at + 4 : at + 8], "little") + 1 & ~1)
    if at + 13 > len(data) or data[at + 8] != 0x2F:
        raise ValueError("not a lossless WebP")
    head = int.from_bytes(data[at + 9 : at + 13], "little")
    if head >> 29:
        raise ValueError("an unknown version")
    return (head & 0x3FFF) + 1, (head >> 14 & 0x3FFF) + 1, at + 13


class Image:
    """A file whose pixels are read, the transforms still to be undone."""

    def __init__(self, data: bytes, max_pixels: int):
        self.width, self.height, at = size_of(data)
        if self.width * self.height > max_pixels:
            raise ValueError("too many pixels")
        b = Bits(data[at:])
        self.undo: list[tuple] = []
        own = self.width
        while b.read(1):
            kind = b.read(2)
            if any(kind == u[0] for u in self.undo):
                raise ValueError("a transform twice")
            if kind < 2:
                shift = b.read(3) + 2
                self.undo.append((kind, own, shift, read_pixels(b, -(-own >> shift), -(-self.height >> shift), False)))
            elif kind == 2:
                self.undo.append((kind, own))
            else:
                n = b.read(8) + 1
                colours = np.cumsum(read_pixels(b, n, 1, False).view(np.uint8).reshape(-1, 4), 0, dtype=np.uint8).view(np.uint32).ravel()
                bundle = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                packed = -(-own >> bundle)
                self.undo.append((kind, own, packed, colours, bundle))
                own = packed
        self.pixels = read_pixels(b, own, self.height, True)
        if b.place() > len(b.data) * 8:
            raise ValueError("the stream ends too early")

    def back(self, predicted: bool) -> bool:
        """Undoes transforms, the last one first, up to the predictor, or from there on; whether a predictor is next."""
        p = self.pixels
        while self.undo:
            kind, wide, *more = self.undo[-1]
            if kind == 0 and not predicted:
                self.pixels = p
                return True
            self.undo.pop()
            if kind == 1:
                p = uncross(p, _spread(more[1], wide, self.height, more[0]))
            elif kind == 2:
                p = unsubtract(p)
            elif kind == 3:
                p = unindex(p, more[0], wide, self.height, more[1], more[2])
        self.pixels = p
        return False

    def rgba(self) -> bytes:
        return self.pixels.astype("<u4").view(np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]].tobytes()


def _finish(images: list[Image]) -> None:
    jobs = [x for x in images if x.back(False)]
    if jobs:
        for x, p in zip(jobs, unpredict([(x.pixels, u[1], u[3], u[2]) for x in jobs for u in x.undo[-1:]])):
            x.pixels = p
            x.back(True)


def decode_many(files: Iterable[bytes | None], max_pixels: int = 64_000_000) -> Iterator[list[tuple]]:
    """(width, height, RGBA bytes, error) of each file, in order, in lists of some BATCH pixels; all None for None."""
    held: list = []
    pixels = 0

    def done() -> list[tuple]:
        _finish([x for x in held if isinstance(x, Image)])
        return [(x.width, x.height, x.rgba(), None) if isinstance(x, Image) else (None, None, None, x) for x in held]

    for data in files:
        try:
            x = None if data is None else Image(data, max_pixels)
        except (ValueError, IndexError) as e:
            x = str(e)
        if isinstance(x, Image):
            size = x.width * x.height
            if held and pixels + size > BATCH:
                yield done()
                held, pixels = [], 0
            pixels += size
        held.append(x)
    if held:
        yield done()


def decode(data: bytes, max_pixels: int = 64_000_000) -> tuple[int, int, bytes]:
    """Width, height and RGBA bytes."""
    width, height, pixels, error = next(decode_many([data], max_pixels))[0]
    if error:
        raise ValueError(error)
    return width, height, pixels


def decode_images(images: DataFrame, *, id_col: str = "image_id", data_col: str = "data", max_pixels: int = 64_000_000) -> DataFrame:
    """image_id, width, height, pixels (RGBA) and error for each row."""
    rows = pick(images, image_id=id_col, data=data_col).withColumn("data", F.col("data").cast("binary"))
    schema = T.StructType([T.StructField("image_id", column_type(rows, "image_id")), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.BinaryType()), T.StructField("error", T.StringType())])

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for found in decode_many((x.as_py() for x in b.column(1)), max_pixels):
                cols = [b.column(0).slice(at, len(found)), *(pa.array(c, f.type) for c, f in zip(zip(*found), list(arrow)[1:]))]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)
                at += len(found)

    return rows.mapInArrow(run, schema)
