"""Measures of arrays, on the Arrow buffers of a batch of rows at a time.

Built-in expressions walk arrays an element at a time, interpreted, and can't add up without copying what they have.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells of a padded table of arrays; more are cut in several.
CELLS = 1 << 18


def lists(a: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where the elements of each row start (and the last end), and all elements; a null row has none."""
    n = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate(([0], np.cumsum(n))), a.flatten()


def numbers(a: pa.Array) -> np.ndarray:
    return a.cast(pa.float64()).to_numpy(zero_copy_only=False)


def padded(starts: np.ndarray):
    """(rows, places, valid) for rows of about the same number of elements, CELLS places at most unless one row has more. Rows without elements are left out."""
    n = np.diff(starts)
    order = np.argsort(n, kind="stable")
    at, end = int(np.searchsorted(n[order], 1)), len(order)
    while at < end:
        to = min(end, at + 1 + CELLS // int(n[order[at]]))
        while to > at + 1 and (to - at) * int(n[order[to - 1]]) > CELLS:
            to = at + (to - at) // 2
        rows = order[at:to]
        k = np.arange(int(n[rows[-1]]))
        valid = k < n[rows][:, None]
        yield rows, np.where(valid, starts[rows][:, None] + k, starts[rows][:, None]), valid
        at = to


def union_areas(starts: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Area of the union of the boxes of each row, by slabs between neighbouring edges; 0 without boxes."""
    out = np.zeros(len(starts) - 1)
    left, right, top, bottom = np.fmin(x0, x1), np.fmax(x0, x1), np.fmin(y0, y1), np.fmax(y0, y1)
    for rows, at, valid in padded(starts):
        l, r, t, b = (np.where(valid, c[at], np.inf) for c in (left, right, top, bottom))
        by = np.lexsort((r, l), axis=1)
        l, r, t, b = (np.take_along_axis(c, by, 1) for c in (l, r, t, b))
        edges = np.sort(np.hstack((t, b)), 1)
        low, high = edges[:, :-1], edges[:, 1:]
        total, reach = np.zeros(low.shape), np.full(low.shape, -1e300)
        for j in range(l.shape[1]):
            inside = (t[:, j, None] <= low) & (b[:, j, None] >= high)
            with np.errstate(invalid="ignore"):
                more = np.maximum(0.0, r[:, j, None] - np.maximum(l[:, j, None], reach))
            total = np.where(inside, total + more, total)
            reach = np.where(inside, np.maximum(reach, r[:, j, None]), reach)
        with np.errstate(invalid="ignore"):
            slabs = np.where(np.isfinite(high), (high - low) * total, 0.0)
        out[rows] = np.cumsum(slabs, 1)[:, -1]
    return out


def union_area(boxes: Column) -> Column:
    """union_areas of an array of boxes. Worked out once where it is, not again in each expression that uses it."""

    @F.arrow_udf("double")
    def areas(boxes: pa.Array) -> pa.Array:
        starts, flat = lists(boxes)
        return pa.array(union_areas(starts, *(numbers(flat.field(c) if not flat.null_count else pc.struct_field(flat, c)) for c in ("x0", "y0", "x1", "y1"))))

    return areas.asNondeterministic()(boxes)


def ends(sizes: Column) -> Column:
    """For an array of whole numbers the sum up to each."""

    @F.arrow_udf("array<bigint>")
    def add(sizes: pa.Array) -> pa.Array:
        starts, flat = lists(sizes)
        total = np.concatenate(([0], np.cumsum(flat.cast(pa.int64()).to_numpy(zero_copy_only=False))))
        n = np.diff(starts)
        own = total[1:] - np.repeat(total[starts[:-1]], n)
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(own, pa.int64()))

    return add(sizes)


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, at, bytes): the letters of text k are those from starts[k], letter i is the bytes from at[i] to at[i + 1]."""
    data, at = text_bytes(texts)
    first = np.flatnonzero((data & 0xC0) != 0x80)
    return np.searchsorted(first, at), np.append(first, len(data)), data


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each one starts; a null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and len(texts.buffers()[2]) else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]] if len(at) else data[:0], at - at[0]


def gap_parts(starts: np.ndarray, at: np.ndarray, data: np.ndarray, x: np.ndarray, one: np.ndarray, gap: float) -> tuple[np.ndarray, pa.Array]:
    """Parts of rows of letters (bytes data[at[i]] to data[at[i + 1]], place x[i]): cut where a letter starts `gap` or more after the last one that is no space."""
    size = np.diff(at)
    seen = np.ones(len(size), bool)
    single = np.flatnonzero(size == 1)
    seen[single[data[at[single]] == 32]] = False
    v = np.flatnonzero(seen)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[v]
    cut = np.zeros(len(v), bool)
    if len(v):
        cut[0] = True
        reach = np.fmax.reduceat(x, v[:-1] + 1)[: len(v) - 1] if len(v) > 1 else np.zeros(0)
        tail = v[-1] + 1  # reduceat goes on to the end for the last
        if len(v) > 1:
            reach[-1] = np.fmax.reduce(x[v[-2] + 1 : tail])
        cut[1:] = (row[1:] != row[:-1]) | (reach - x[v[:-1]] >= gap)
    p = np.flatnonzero(cut)
    last = np.append(p[1:], len(v))[: len(p)] - 1
    kept = data[np.repeat(seen, size)]
    text_at = np.concatenate(([0], np.cumsum(size[v])))[np.append(p, len(v)) if len(v) else [0]]
    text = pa.LargeStringArray.from_buffers(len(p), pa.py_buffer(text_at.astype(np.int64)), pa.py_buffer(kept)).cast(pa.string())
    x0, x1 = x[v[p]], x[v[last]] + one[row[p]]
    own = pa.StructArray.from_arrays([text, pa.array(x0, from_pandas=True), pa.array(x1, from_pandas=True)], ["text", "x0", "x1"])
    return np.searchsorted(row[p], np.arange(len(starts))), own


def split_on_gaps(text: Column, x0: Column, x1: Column, places: Column, gap: float) -> Column:
    """Parts (text, x0, x1) of texts from x0 to x1; places: null, or an array of (ch, x). Null where there are none."""

    @F.arrow_udf("array<struct<text:string,x0:double,x1:double>>")
    def cut(text: pa.Array, x0: pa.Array, one: pa.Array, places: pa.Array) -> pa.Array:
        given = pc.fill_null(pc.greater(pc.list_value_length(places), 0), False).to_numpy(zero_copy_only=False)
        parts, order, n = [], [], []
        for these in (np.flatnonzero(given), np.flatnonzero(~given)):
            if not len(these):
                continue
            step = numbers(one)[these]
            if given[these[0]]:
                starts, flat = lists(places if len(these) == len(given) else places.take(pa.array(these)))
                data, at = text_bytes(pc.struct_field(flat, "ch"))
                x = numbers(pc.struct_field(flat, "x"))
            else:
                starts, at, data = _letters(text if len(these) == len(given) else text.take(pa.array(these)))
                k = np.diff(starts)
                x = np.repeat(numbers(x0)[these], k) + (np.arange(starts[-1]) - np.repeat(starts[:-1], k)) * np.repeat(step, k)
            found, own = gap_parts(starts, at, data, x, step, gap)
            parts.append(own), order.append(these), n.append(np.diff(found))
        if len(parts) < 2:
            starts, flat = np.concatenate(([0], np.cumsum(n[0]))) if n else np.zeros(1, int), parts[0] if parts else None
        else:
            rows, many = np.concatenate(order), np.concatenate(n)
            flat = pa.concat_arrays(parts).take(pa.array(np.argsort(np.repeat(rows, many), kind="stable")))
            starts = np.concatenate(([0], np.cumsum(many[np.argsort(rows)])))
        if flat is None:
            return pa.array([], pa.list_(pa.struct([("text", pa.string()), ("x0", pa.float64()), ("x1", pa.float64())])))
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), flat)

    one = (x1 - x0) / F.greatest(F.length(text), F.lit(1))
    return cut(text, x0.cast("double"), one.cast("double"), places)
