"""A small lossless WebP writer, to make images where a table holds none and for exact round trips in the tests.

Every tool of the format can be turned on by itself; the writer aims at covering them, not at small files. Many images are written at once in numpy, each as it would be by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.llm.common import column_type, map_arrow, pick
from quire.llm.webp import LENGTH_ORDER, NEAR, OPAQUE, TURNED


@dataclass(frozen=True)
class Options:
    predictor: int = 0  # block shift, 2 to 9; 0 is off
    cross: int = 0
    subtract: bool = False
    palette: bool = False
    cache_bits: int = 0
    matches: bool = False
    groups: int = 0


class Items:
    """Values and the bits of each, for many files at once: what is put first for a file stands first in it."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []

    def put(self, files: np.ndarray, values, bits) -> None:
        """Values of at most 62 bits."""
        self.parts.append((files, np.broadcast_to(np.asarray(values, np.int64), files.shape), np.broadcast_to(np.asarray(bits, np.int64), files.shape)))

    def bytes(self, n: int) -> list[bytes]:
        """The bytes of the files 0 to n - 1."""
        files, values, bits = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(files.astype(np.uint16) if n < 1 << 16 else files, kind="stable")
        order = order[bits[order] > 0]
        files, values, bits = files[order], values[order].view(np.uint64), bits[order]
        total = np.bincount(files, bits, n).astype(np.int64)
        starts = np.cumsum(np.append(0, total + 63 >> 6))
        at = np.cumsum(bits) - bits + (starts[:-1] * 64 - (np.cumsum(total) - total))[files]
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        cuts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out = np.zeros(starts[-1], "<u8")
        out[word[cuts]] = np.bitwise_or.reduceat(values << shift, cuts)
        over = np.flatnonzero((at & 63) + bits > 64)  # one in a word at most
        out[word[over] + 1] |= values[over] >> np.uint64(64) - shift[over]
        raw = out.view(np.uint8)
        return [raw[8 * s : 8 * s + (t + 7 >> 3)].tobytes() for s, t in zip(starts.tolist(), total.tolist())]


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def lengths_of(code: np.ndarray, counts: np.ndarray, codes: int, most: int) -> np.ndarray:
    """Lengths of complete codes of at most `most` bits for two or more counts above 0 each, sorted by code: the logarithm rounded up, then as many of the longest shortened as fill the code."""
    while True:
        n = np.clip(np.ceil(np.log2(np.bincount(code, counts, codes)[code] / counts)).astype(np.int64), 1, most)
        left = (1 << most) - np.bincount(code, 1 << most - n, codes).astype(np.int64)
        if (left >= 0).all():
            break
        counts = np.where(left[code] < 0, counts // 2 + 1, counts)
    held = np.bincount(code * (most + 1) + n, minlength=codes * (most + 1)).reshape(codes, most + 1)
    for k in range(most, 1, -1):
        shorter = np.minimum(left >> most - k, held[:, k])
        held[:, k] -= shorter
        held[:, k - 1] += shorter
        left -= shorter << most - k
    out = np.empty(len(counts), np.int64)
    out[np.argsort((code << 40) - counts, kind="stable")] = np.repeat(np.tile(np.arange(most + 1), codes), held.ravel())
    return out


def codes_of(code: np.ndarray, lengths: np.ndarray, codes: int) -> np.ndarray:
    """The bits to write for each symbol in order, of its length."""
    key = code * 16 + lengths
    held = np.bincount(key, minlength=codes * 16)
    by = held.reshape(codes, 16)
    first, next_ = np.zeros((codes, 16), np.int64), np.zeros(codes, np.int64)
    for n in range(16):
        next_ <<= 1
        first[:, n] = next_
        next_ += by[:, n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    out = np.empty(len(lengths), np.int64)
    out[order] = TURNED[15][first.ravel()[key] + np.arange(len(key)) - _starts(held)[key]] >> 15 - (key & 15)
    return out


def put_codes(items: Items, files: np.ndarray, code: np.ndarray, symbol: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes codes, that of files[c] for c, of the symbols and counts sorted by code; returns what to write for each symbol, and in how many bits."""
    codes = len(files)
    value, bits = np.zeros((2, len(code)), np.int64)
    held = np.bincount(code, minlength=codes)
    first = _starts(held)
    last = np.full(codes, -1)
    last[held > 0] = symbol[(first + held - 1)[held > 0]]
    simple = (held <= 2) & (last < 256)
    lead = np.zeros(codes, np.int64)
    lead[held > 0] = symbol[first[held > 0]]
    two = simple & (held == 2)
    told = 1 | two << 1 | 1 << 2 | lead << 3 | np.where(two, last, 0) << 11
    of_two = np.flatnonzero(two[code])
    bits[of_two] = 1
    value[of_two[1::2]] = 1
    out = [(np.flatnonzero(simple), told[simple], 11 + 8 * two[simple])]
    full = np.flatnonzero(~simple)
    if len(full):
        name = np.cumsum(~simple) - 1
        rows = np.flatnonzero(~simple[code])
        c, s = name[code[rows]], symbol[rows]
        many = held[full][c] > 1
        lengths = np.ones(len(rows), np.int64)
        if many.any():
            at = rows[many]
            lengths[many] = lengths_of(c[many], counts[at], len(full), 15)
            value[at], bits[at] = codes_of(c[many], lengths[many], len(full)), lengths[many]
        sizes = last[full] + 1
        starts = _starts(sizes)
        flat = np.zeros(sizes.sum(), np.int64)
        flat[starts[c] + s] = lengths
        new = np.append(True, flat[1:] != flat[:-1])
        new[starts] = True
        run = np.flatnonzero(new)
        of = np.repeat(np.arange(len(full)), np.add.reduceat(new.astype(np.int64), starts))
        n, left = flat[run], np.diff(np.append(run, len(flat)))
        some = n > 0
        left -= some
        most = np.where(some, 6, 138)
        rest = left % most
        few, short = rest < 3, rest < 11
        zero = np.zeros(len(run), np.int64)
        # symbol, extra value and extra bits of: the length itself, repeats of the most, what is left
        times = np.stack([some, left // most, np.where(few, rest, 1)], 1).ravel()
        table = [np.repeat(np.stack(x, 1).ravel(), times) for x in (
            (n, np.where(some, 16, 18), np.where(few, n, np.where(some, 16, np.where(short, 17, 18)))),
            (zero, np.where(some, 3, 127), np.where(few, 0, np.where(some | short, rest - 3, rest - 11))),
            (zero, np.where(some, 2, 7), np.where(few, 0, np.where(some, 2, np.where(short, 3, 7)))),
        )]
        of = np.repeat(np.repeat(of, 3), times)
        own = np.bincount(of * 19 + table[0], minlength=len(full) * 19)
        used = np.flatnonzero(own)
        kinds = np.bincount(used // 19, minlength=len(full))
        inner, words = np.zeros((2, len(own)), np.int64)
        inner[used] = 1
        used = used[kinds[used // 19] > 1]
        if len(used):
            inner[used] = lengths_of(used // 19, own[used], len(full), 7)
            words[used] = codes_of(used // 19, inner[used], len(full))
        head = np.full(len(full), 15 << 1)
        for k, m in enumerate(LENGTH_ORDER):
            head |= inner[m::19] << 5 + 3 * k
        out.append((full, head, np.full(len(full), 62)))
        rows = np.bincount(of, minlength=len(full))
        more = np.maximum(rows - 2, 0)
        size = np.ceil(np.log2(more + 1)).astype(np.int64)
        size = np.maximum(2, size + size % 2)
        out.append((full, np.where(rows > 1, 1 | size - 2 >> 1 << 1 | more << 4, 0), np.where(rows > 1, 4 + size, 1)))  # stop after so many of them
        key = of * 19 + table[0]
        wide = np.where(kinds[of] > 1, inner[key], 0)
        out.append((full[of], words[key] | table[1] << wide, wide + table[2]))
    code, values, n = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(code, kind="stable")
    items.put(files[code[order]], values[order], n[order])
    return value, bits


def _prefixes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbols, extra values and extra bits of lengths or distances from 1."""
    v = v.astype(np.int64) - 1
    n = np.maximum(0, np.floor(np.log2(np.maximum(v, 1))).astype(np.int64) - 1)
    few = v < 4
    return np.where(few, v, 2 * (n + 1) + (v >> n & 1)), np.where(few, 0, v & (1 << n) - 1), np.where(few, 0, n)


def _before(keys: np.ndarray) -> np.ndarray:
    """Where each key stood last, -1 if nowhere; of 64 bits, those that the places leave free are compared."""
    bits = np.uint64(len(keys).bit_length())
    both = np.sort(keys.astype(np.uint64) << bits | np.arange(len(keys), dtype=np.uint64))
    key, order = both >> bits, (both & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)
    out = np.full(len(keys), -1)
    same = key[1:] == key[:-1]
    out[order[1:][same]] = order[:-1][same]
    return out


@lru_cache(1000)
def _near_codes(width: int) -> np.ndarray:
    """The code of each distance up to the largest of the short ones."""
    found = {max(1, x + y * width): k for k, (x, y) in reversed(list(enumerate(NEAR, 1)))}
    out = np.arange(max(found) + 1) + 120
    out[list(found)] = list(found.values())
    return out


def references(pixels: np.ndarray, image: np.ndarray, left: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places, lengths and distance codes of back-references, taken greedily wherever the last three pixels like these of the image allow it; left: how many pixels of the image follow each."""
    p = pixels.astype(np.uint64)
    keys = (p[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ p[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(3) + p[2:]
    found = _before((keys ^ image[: len(keys)].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9FB21C651E98DF25) >> np.uint64(20))
    at = np.flatnonzero((found >= 0) & (left[: len(keys)] >= 2))
    found = found[at]
    good = image[at] == image[found]
    for k in range(3):
        good &= pixels[at + k] == pixels[found + k]
    at, found = at[good], found[good]
    if not len(at):
        return at, at, at
    on = (at[1:] == at[:-1] + 1) & (found[1:] == found[:-1] + 1)  # the next place refers to the next one
    stops = np.append(np.flatnonzero(~on), len(at) - 1)
    length = np.minimum(at[stops[np.searchsorted(stops, np.arange(len(at)))]] - at + 3, 4096)
    after = np.searchsorted(at, at + length).tolist()
    taken, k = [], 0
    while k < len(after):
        taken.append(k)
        k = after[k]
    at, found, length = at[taken], found[taken], length[taken]
    d, own = at - found, image[at]
    tables = [_near_codes(w) for w in widths.tolist()]
    sizes = np.array([len(t) for t in tables])
    near = d < sizes[own]
    return at, length, np.where(near, np.concatenate(tables)[np.where(near, _starts(sizes)[own] + d, 0)], d + 120)


class Grid:
    """Where the pixels of images, one image after the other, stand in them."""

    def __init__(self, widths: np.ndarray, heights: np.ndarray):
        self.widths, self.heights, self.sizes = widths, heights, widths * heights
        self.starts = _starts(self.sizes)
        self.image = np.repeat(np.arange(len(widths)), self.sizes)
        self.index = np.arange(len(self.image)) - self.starts[self.image]

    @cached_property
    def wide(self) -> np.ndarray:
        return self.widths[self.image]

    @cached_property
    def y(self) -> np.ndarray:
        return (self.index.astype(np.uint32) // self.wide.astype(np.uint32)).astype(np.int64)

    @cached_property
    def x(self) -> np.ndarray:
        return self.index - self.y * self.wide

    def blocks(self, shift: int) -> tuple[Grid, np.ndarray]:
        """The grid of the blocks and the number of each pixel's block in its image."""
        across = -(-self.widths >> shift)
        return Grid(across, -(-self.heights >> shift)), (self.y >> shift) * across[self.image] + (self.x >> shift)


def put_pixels(items: Items, files: np.ndarray, pixels: np.ndarray, grid: Grid, top: bool, o: Options) -> None:
    """pixels: ARGB as int64, of an image for each of the files."""
    items.put(files, 1 | o.cache_bits << 1 if o.cache_bits else 0, 5 if o.cache_bits else 1)
    shift = 2
    group = np.zeros(len(pixels), np.int64)
    groups, own_groups = 1, np.ones(len(files), np.int64)
    if top:
        items.put(files, o.groups > 1, 1)
        if o.groups > 1:
            groups = o.groups
            inner, _ = grid.blocks(shift)
            items.put(files, shift - 2, 3)
            put_pixels(items, files, OPAQUE | (inner.x + inner.y) % groups << 8, inner, False, Options())
            group = ((grid.x >> shift) + (grid.y >> shift)) % groups
            own_groups = np.minimum(groups, inner.widths + inner.heights - 1)
    kind = np.zeros(len(pixels), np.int8)  # 0 literal, 1 in the cache, 2 reference, 3 inside of one
    place = np.zeros(len(pixels), np.int64)
    if o.cache_bits:
        place = (pixels * 0x1E35A7BD & 0xFFFFFFFF) >> 32 - o.cache_bits
        last = _before(grid.image << o.cache_bits | place)
        kind[(last >= 0) & (pixels[last] == pixels)] = 1
    length = far = np.zeros(0, np.int64)
    if o.matches:
        at, length, far = references(pixels, grid.image, grid.sizes[grid.image] - 1 - grid.index, grid.widths)
        inside = np.zeros(len(pixels) + 1, np.int64)
        inside[at] += 1
        inside[at + length] -= 1
        kind[np.cumsum(inside[:-1]) > 0] = 3
        kind[at] = 2
    at = np.flatnonzero(kind < 3)
    kind, p = kind[at], pixels[at]
    lit, ref, hit = np.flatnonzero(kind == 0), np.flatnonzero(kind == 2), np.flatnonzero(kind == 1)
    ls, lx, ln = _prefixes(length)
    ds, dx, dn = _prefixes(far)
    green = p >> 8 & 255
    green[ref] = 256 + ls
    green[hit] = 280 + place[at[hit]]
    offsets = np.cumsum([0, 280 + (1 << o.cache_bits if o.cache_bits else 0), 256, 256, 256, 40])
    base = (grid.image[at] * groups + group[at]) * offsets[5]
    q, literal = p[lit], base[lit]
    spots = [base + green]
    same = literal
    for k, channel in enumerate((q >> 16 & 255, q & 255, q >> 24)):
        if len(lit) and channel.min() == channel.max():  # codes of one symbol and no bits, however often it is there
            if same is literal:
                same = np.flatnonzero(np.bincount(literal // offsets[5])) * offsets[5]
            spots.append(same + (offsets[1 + k] + channel[0]))
        else:
            spots.append(literal + (offsets[1 + k] + channel))
    spots.append(base[ref] + (offsets[4] + ds))
    counts = np.bincount(np.concatenate(spots), minlength=len(files) * groups * offsets[5])
    there = np.flatnonzero(counts)
    owner, symbol = np.divmod(there, offsets[5])
    which = np.searchsorted(offsets, symbol, "right") - 1
    known = (np.arange(groups) < own_groups[:, None]).ravel()  # an image of few blocks has fewer groups
    name = np.cumsum(known) - 1
    v, n = put_codes(items, np.repeat(np.repeat(files, own_groups), 5), name[owner] * 5 + which, symbol - offsets[which], counts[there])
    table = np.zeros(len(counts), np.int64)
    table[there] = v << 4 | n
    e = table[spots[0]]
    value, bits = e >> 4, e & 15
    for spot in spots[1:4]:
        if len(spot) == len(lit):
            e = table[spot]
            value[lit] |= e >> 4 << bits[lit]
            bits[lit] += e & 15
    e = table[spots[4]]
    for x, k in ((lx, ln), (e >> 4, e & 15), (dx, dn)):
        value[ref] |= x << bits[ref]
        bits[ref] += k
    items.put(files[grid.image[at]], value, bits)


def _predicted(p: np.ndarray, mode: np.ndarray, grid: Grid) -> np.ndarray:
    """Prediction of each pixel of p (pixels, 4 as int16) under the mode of its place."""
    half = lambda a, b: (a + b) >> 1
    clip = lambda a: np.clip(a, 0, 255)

    def step(l, u, c, r):
        m = half(l, u)
        return clip(m + np.sign(m - c) * (np.abs(m - c) >> 1))

    made = (
        lambda l, u, c, r: opaque, lambda l, u, c, r: l, lambda l, u, c, r: u, lambda l, u, c, r: r, lambda l, u, c, r: c,
        lambda l, u, c, r: half(half(l, r), u), lambda l, u, c, r: half(l, c), lambda l, u, c, r: half(l, u), lambda l, u, c, r: half(c, u), lambda l, u, c, r: half(u, r),
        lambda l, u, c, r: half(half(l, c), half(u, r)), lambda l, u, c, r: np.where((np.abs(u - c).sum(1) < np.abs(l - c).sum(1))[:, None], l, u), lambda l, u, c, r: clip(l + u - c), step,
    )
    opaque = np.array([0, 0, 0, 255], np.int16)
    whole = np.ascontiguousarray(p).view(np.int64).ravel()
    at = lambda j: whole.take(j, mode="clip").view(np.int16).reshape(-1, 4)
    out = np.zeros_like(p)
    mode = np.where(grid.y == 0, np.where(grid.x == 0, 0, 1), np.where(grid.x == 0, 2, mode)).astype(np.int8)
    order = np.argsort(mode, kind="stable")
    ends = np.searchsorted(mode[order], np.arange(15))
    for k in range(14):
        j = order[ends[k] : ends[k + 1]]
        if len(j):
            up = j - grid.wide[j]
            out[j] = made[k](at(j - 1), at(up), at(up - 1), at(up + 1))
    return out


def _argb(p: np.ndarray) -> np.ndarray:
    q = np.ascontiguousarray(p).astype(np.uint8).view("<u4").ravel().astype(np.int64)
    return q & 0xFF00FF00 | (q & 255) << 16 | q >> 16 & 255


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & 255).astype(np.uint8).view(np.int8).astype(np.int32)


def _put_palettes(items: Items, files: np.ndarray, p: np.ndarray, grid: Grid) -> tuple[np.ndarray, Grid]:
    """Writes the palettes of the images of at most 256 colours; returns the pixels, indexes where there is a palette, and their grid."""
    if (p[:, 3] == 255).all() and (p[:, 0] == p[:, 1]).all() and (p[:, 1] == p[:, 2]).all():  # greys need no sort
        key = grid.image << 8 | p[:, 0]
        there = np.bincount(key, minlength=len(files) << 8) > 0
        colours, index = np.flatnonzero(there), (np.cumsum(there) - 1)[key]
        colours = colours >> 8 << 32 | OPAQUE | (colours & 255) * 0x10101
    else:
        colours, index = np.unique(grid.image << 32 | _argb(p), return_inverse=True)
    counts = np.bincount(colours >> 32, minlength=len(files))
    has = counts <= 256
    own = files[has]
    if not len(own):
        return p, grid
    items.put(own, 7, 3)
    items.put(own, counts[has] - 1, 8)
    table = (colours & 0xFFFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4)
    less = np.concatenate((np.zeros((1, 4), np.uint8), table[:-1]))
    less[_starts(counts)] = 0
    steps = (table - less).view("<u4").ravel().astype(np.int64)[has[colours >> 32]]
    put_pixels(items, own, steps, Grid(counts[has], np.ones(len(own), np.int64)), False, Options())
    bundle = np.where(has, np.where(counts <= 2, 3, np.where(counts <= 4, 2, np.where(counts <= 16, 1, 0))), 0)
    index = index.ravel() - _starts(counts)[grid.image]
    if has.all() and not bundle.any():
        out = np.zeros((len(index), 4), np.int16)
        out[:, 1], out[:, 3] = index, 255
        return out, grid
    packed = Grid(-(-grid.widths >> bundle), grid.heights)
    shift = bundle[grid.image]
    at = packed.starts[grid.image] + grid.y * packed.widths[grid.image] + (grid.x >> shift)
    green = np.bincount(at, index << (grid.x & (1 << shift) - 1) * (8 >> shift), len(packed.image))
    out = np.zeros((len(packed.image), 4), np.int16)
    out[:, 1], out[:, 3] = green, 255
    rows = np.flatnonzero(~has[grid.image])
    out[at[rows]] = p[rows]
    return out, packed


def encode_many(images: list[np.ndarray], o: Options = Options(), seed: int = 0) -> list[bytes]:
    """The files of arrays (height, width, 4) of bytes."""
    if not images:
        return []
    grid = Grid(np.array([a.shape[1] for a in images]), np.array([a.shape[0] for a in images]))
    files = np.arange(len(images))
    items = Items()
    p = np.concatenate([a.reshape(-1, 4) for a in images]).astype(np.int16)
    clear = np.minimum.reduceat(p[:, 3], grid.starts) < 255
    items.put(files, grid.widths - 1 | grid.heights - 1 << 14 | clear.astype(np.int64) << 28, 32)
    plain = Options(cache_bits=2 if o.cache_bits else 0)
    if o.palette:
        p, grid = _put_palettes(items, files, p, grid)
    if o.predictor:
        inner, block = grid.blocks(o.predictor)
        modes = (np.arange(29) * 5 + seed) % 14
        items.put(files, 1 | o.predictor - 2 << 3, 6)
        put_pixels(items, files, OPAQUE | modes[inner.index % 29] << 8, inner, False, plain)
        p = p - _predicted(p, modes[block % 29], grid) & 255
    if o.cross:
        inner, block = grid.blocks(o.cross)
        found = (np.arange(1, 18) * 0x35A1C7 + seed * 0x010305) & 0xFFFFFF
        items.put(files, 3 | o.cross - 2 << 3, 6)
        put_pixels(items, files, OPAQUE | found[inner.index % 17], inner, False, plain)
        t, green, red = found[block % 17], _signed(p[:, 1]), _signed(p[:, 0])
        p = p.copy()
        p[:, 0] -= _signed(t) * green >> 5
        p[:, 2] -= (_signed(t >> 8) * green >> 5) + (_signed(t >> 16) * red >> 5)
        p &= 255
    if o.subtract:
        items.put(files, 5, 3)
        p = p.copy()
        p[:, 0] -= p[:, 1]
        p[:, 2] -= p[:, 1]
        p &= 255
    items.put(files, 0, 1)
    put_pixels(items, files, _argb(p), grid, True, o)
    out = []
    for body in items.bytes(len(images)):
        body = b"\x2f" + body
        body += b"\0" * (-len(body) % 2)
        size = len(body)
        out.append(b"RIFF" + (size + 12).to_bytes(4, "little") + b"WEBPVP8L" + size.to_bytes(4, "little") + body)
    return out


def encode(rgba: np.ndarray, o: Options = Options(), seed: int = 0) -> bytes:
    """The file of an array (height, width, 4) of bytes."""
    return encode_many([rgba], o, seed)[0]


#: About how many pixels are written at once.
BATCH = 500_000

#: What the images of a table use, in turn.
VARIANTS = (
    Options(predictor=2, subtract=True, cache_bits=5, matches=True),
    Options(palette=True, matches=True),
    Options(cross=2, subtract=True, cache_bits=6),
    Options(predictor=3, cross=3, matches=True, groups=2),
    Options(palette=True, predictor=2, cache_bits=3),
    Options(subtract=True, matches=True, groups=3),
)


def picture(text: str, grey: bool) -> np.ndarray:
    """All bytes of the text as an opaque image, about square: three bytes a pixel, or one in grey, zeros after the end."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-len(raw) // (1 if grey else 3)))
    w = max(1, math.ceil(math.sqrt(n)))
    h = -(-n // w)
    out = np.full((h, w, 4), 255, np.uint8)
    body = np.zeros(h * w * (1 if grey else 3), np.uint8)
    body[: len(raw)] = raw
    out[..., :3] = body.reshape(h, w, -1)
    return out


def picture_files(texts: DataFrame, *, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """image_id and data: a lossless WebP of the picture of each text, its options by turns; null where the text is null."""
    rows = pick(texts, image_id=id_col, text=text_col)
    schema = T.StructType([T.StructField("image_id", column_type(rows, "image_id")), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            data: list[bytes | None] = [None] * len(b["text"])
            for k, o in enumerate(VARIANTS):
                rows = [n for n, (i, t) in enumerate(zip(b["image_id"], b["text"])) if t is not None and (i or 0) % len(VARIANTS) == k]
                while rows:
                    some, pixels = [], 0
                    while rows and (not some or pixels < BATCH):
                        some.append((rows[0], picture(b["text"][rows.pop(0)], o.palette)))
                        pixels += some[-1][1].size // 4
                    for (n, _), file in zip(some, encode_many([a for _, a in some], o, k)):
                        data[n] = file
            yield {"image_id": b["image_id"], "data": data}

    return map_arrow(rows, run, schema)
