"""Stage 3: reading order by recursive cuts or by bands, and how coherent it is."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import DEFAULT, EngineConfig
from quire.functions import arrays
from quire.operators import blocks as B


def cut_side(lo: Column, hi: Column, cut: Column) -> Column:
    """before or after: where the larger part of lo to hi lies; a tie is before."""
    before, after = F.greatest(F.lit(0.0), F.least(hi, cut) - lo), F.greatest(F.lit(0.0), hi - F.greatest(lo, cut))
    return F.when(lo.isNull(), "before").when(hi <= lo, F.when(lo <= cut, "before").otherwise("after")).when(before >= after, "before").otherwise("after")


def coverage(lo: np.ndarray, hi: np.ndarray, start: float, end: float, across_lo: np.ndarray, across_hi: np.ndarray, extent: float, bins: int) -> np.ndarray:
    """Share of the extent covered in each bin between start and end, by the union of the boxes that touch it."""
    size = (end - start) / bins
    first = np.maximum(0, ((lo - start) / size).astype(int))
    last = np.minimum(bins - 1, ((hi - start) / size).astype(int))
    order = np.argsort(across_lo, kind="stable")
    order = order[across_hi[order] > across_lo[order]]
    if not len(order):
        return np.zeros(bins)
    at = np.arange(bins)[:, None]
    touch = (first[order] <= at) & (at <= last[order])
    low, high = across_lo[order], across_hi[order]
    reach = np.full(touch.shape, -np.inf)  # how far the boxes before go, by bin
    reach[:, 1:] = np.maximum.accumulate(np.where(touch, high, -np.inf), 1)[:, :-1]
    new = np.where(touch, np.maximum(0.0, high - np.maximum(low, reach)), 0.0)
    return np.cumsum(new, 1)[:, -1] / extent


def best_cut(cover: np.ndarray, start: float, end: float, gap: float) -> float | None:
    """Centre of the emptiest bin with the fullest neighbours; the first of equals."""
    padded = np.concatenate((cover[:1], cover[:1], cover, cover[-1:], cover[-1:]))
    n = len(cover)
    clarity = (np.maximum(padded[1 : n + 1], padded[:n]) + np.maximum(padded[3 : n + 3], padded[4 : n + 4])) / 2
    clarity[(cover > gap) | (np.arange(n) == 0) | (np.arange(n) == n - 1)] = 0
    k = int(np.argmax(clarity))
    return start + (k + 0.5) * (end - start) / n if clarity[k] > 0 else None


def xy_cut(boxes: np.ndarray, rtl: bool, cfg: EngineConfig = DEFAULT) -> list[int]:
    """Order of boxes (n x 4, NaN where missing): cut across first, else down, else sorted by line."""
    side = -1.0 if rtl else 1.0

    def before(lo: np.ndarray, hi: np.ndarray, cut: float) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            a, b = np.maximum(0.0, np.minimum(hi, cut) - lo), np.maximum(0.0, hi - np.maximum(lo, cut))
            return np.isnan(lo) | np.where(hi <= lo, lo <= cut, a >= b)

    def walk(ids: np.ndarray, depth: int) -> list[int]:
        if len(ids) <= 1 or depth >= cfg.max_depth:
            return ids.tolist()
        own = boxes[ids]
        seen = own[~np.isnan(own[:, 0])]
        if len(seen):
            x0, y0, x1, y1 = seen[:, 0].min(), seen[:, 1].min(), seen[:, 2].max(), seen[:, 3].max()
            for down in (False, True):
                lo, hi, a, b = (0, 2, x0, x1) if down else (1, 3, y0, y1)
                alo, ahi, extent = (1, 3, y1 - y0) if down else (0, 2, x1 - x0)
                if b <= a or extent <= 0:
                    continue
                cut = best_cut(coverage(seen[:, lo], seen[:, hi], a, b, seen[:, alo], seen[:, ahi], extent, cfg.bins), a, b, cfg.gap_fraction)
                if cut is None:
                    continue
                first = before(own[:, lo], own[:, hi], cut)
                if first.all() or not first.any():
                    continue
                parts = [ids[first], ids[~first]]
                if down and rtl:
                    parts.reverse()
                return walk(parts[0], depth + 1) + walk(parts[1], depth + 1)
        key = np.nan_to_num(own)
        return ids[np.lexsort((side * key[:, 0], key[:, 1]))].tolist()

    return walk(np.arange(len(boxes)), 0)


def covers(lo: np.ndarray, hi: np.ndarray, start: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, valid: np.ndarray, extent: np.ndarray, bins: int) -> np.ndarray:
    """coverage of many groups of boxes, a group a row; low and high are the ends across."""
    with np.errstate(invalid="ignore"):
        first = np.maximum(0, np.where(valid, (lo - start[:, None]) / size[:, None], 0.0).astype(int))
        last = np.minimum(bins - 1, np.where(valid, (hi - start[:, None]) / size[:, None], 0.0).astype(int))
        use = valid & (high > low)
    by = np.argsort(np.where(use, low, np.inf), axis=1, kind="stable")
    first, last, low, high, use = (np.take_along_axis(c, by, 1) for c in (first, last, low, high, use))
    bin_ = np.arange(bins)
    total, reach = np.zeros((len(lo), bins)), np.full((len(lo), bins), -np.inf)
    for j in range(int(use.sum(1).max(initial=0))):
        touch = use[:, j, None] & (first[:, j, None] <= bin_) & (bin_ <= last[:, j, None])
        total += np.where(touch, np.maximum(0.0, high[:, j, None] - np.maximum(low[:, j, None], reach)), 0.0)
        reach = np.where(touch, np.maximum(reach, high[:, j, None]), reach)
    return total / extent[:, None]


def best_cuts(cover: np.ndarray, start: np.ndarray, end: np.ndarray, gap: float) -> np.ndarray:
    """best_cut of many groups, NaN where there is none."""
    n = cover.shape[1]
    padded = np.hstack((cover[:, :1], cover[:, :1], cover, cover[:, -1:], cover[:, -1:]))
    clarity = (np.maximum(padded[:, 1 : n + 1], padded[:, :n]) + np.maximum(padded[:, 3 : n + 3], padded[:, 4 : n + 4])) / 2
    clarity[cover > gap] = 0
    clarity[:, [0, -1]] = 0
    k = np.argmax(clarity, 1)
    return np.where(clarity[np.arange(len(k)), k] > 0, start + (k + 0.5) * (end - start) / n, np.nan)


def xy_cuts(starts: np.ndarray, boxes: np.ndarray, rtl: np.ndarray, cfg: EngineConfig = DEFAULT) -> np.ndarray:
    """xy_cut of many pages: the boxes of page k are those from starts[k]. All pages are cut at once, a level of depth after the other."""
    place = np.arange(len(boxes)) - np.repeat(starts[:-1], np.diff(starts))  # the order found so far, as numbers of boxes of a page
    base = np.repeat(starts[:-1], np.diff(starts))
    groups = np.stack((starts[:-1], starts[1:], np.arange(len(starts) - 1)), 1)  # from, to, page
    for depth in range(cfg.max_depth + 1):
        groups = groups[groups[:, 1] - groups[:, 0] > 1]
        if depth >= cfg.max_depth or not len(groups):
            break
        more = []
        size = groups[:, 1] - groups[:, 0]
        by = np.argsort(size, kind="stable")
        at = 0
        while at < len(by):
            to = at + 1
            while to < len(by) and size[by[to]] <= 2 * size[by[at]] and (to + 1 - at) * max(int(size[by[to]]), cfg.bins) <= arrays.CELLS:
                to += 1
            more.append(_cut_groups(groups[by[at:to]], place, base, boxes, rtl, cfg))
            at = to
        groups = np.concatenate(more)
    return place


def _cut_groups(groups: np.ndarray, place: np.ndarray, base: np.ndarray, boxes: np.ndarray, rtl: np.ndarray, cfg: EngineConfig) -> np.ndarray:
    """Cuts each group where it can be cut, else sorts it; place is changed, the parts are returned."""
    size = groups[:, 1] - groups[:, 0]
    k = np.arange(int(size.max()))
    real = k < size[:, None]
    at = np.where(real, groups[:, :1] + k, groups[:, :1])
    ids = place[at]
    own = boxes[base[at] + ids]
    right = rtl[groups[:, 2]]
    seen = real & ~np.isnan(own[:, :, 0])
    low, high = (lambda i: np.where(seen, own[:, :, i], np.inf).min(1)), (lambda i: np.where(seen, own[:, :, i], -np.inf).max(1))
    x0, y0, x1, y1 = low(0), low(1), high(2), high(3)
    side, done = np.zeros(real.shape, bool), ~seen.any(1)
    cut = np.zeros(len(groups), int)  # 1: across, 2: down
    for down in (False, True):
        lo, hi, a, b = (0, 2, x0, x1) if down else (1, 3, y0, y1)
        alo, ahi, extent = (1, 3, y1 - y0) if down else (0, 2, x1 - x0)
        with np.errstate(invalid="ignore"):
            g = np.flatnonzero((cut == 0) & ~done & (b > a) & (extent > 0))
        if not len(g):
            continue
        o = own[g]
        where = best_cuts(covers(o[:, :, lo], o[:, :, hi], a[g], (b[g] - a[g]) / cfg.bins, o[:, :, alo], o[:, :, ahi], seen[g], extent[g], cfg.bins), a[g], b[g], cfg.gap_fraction)
        with np.errstate(invalid="ignore"):
            l, h, c = o[:, :, lo], o[:, :, hi], where[:, None]
            before = np.isnan(l) | np.where(h <= l, l <= c, np.maximum(0.0, np.minimum(h, c) - l) >= np.maximum(0.0, h - np.maximum(l, c)))
        n = (before & real[g]).sum(1)
        ok = ~np.isnan(where) & (n > 0) & (n < size[g])
        cut[g[ok]] = 2 if down else 1
        side[g[ok]] = before[ok]
    is_cut = cut > 0
    turn = is_cut & (cut == 2) & right
    key = np.nan_to_num(own)
    first = np.where(is_cut[:, None], np.where(side ^ turn[:, None], 0.0, 1.0), key[:, :, 1])
    second = np.where(is_cut[:, None], 0.0, np.where(right[:, None], -1.0, 1.0) * key[:, :, 0])
    order = np.lexsort((second, first, ~real), axis=1)
    place[at[real]] = np.take_along_axis(ids, order, 1)[real]
    n = ((side ^ turn[:, None]) & real).sum(1)[is_cut]
    c = groups[is_cut]
    return np.concatenate((np.stack((c[:, 0], c[:, 0] + n, c[:, 2]), 1), np.stack((c[:, 0] + n, c[:, 1], c[:, 2]), 1)))


def xy_order(blocks: DataFrame, directions: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """block_id and place in the recursive order. A page is a row of boxes, so Python sees batches of pages and no text."""
    slim = blocks.select(*B.PAGE, F.struct("seq", "block_id", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1").alias("b")).join(directions, "doc_id")
    packed = slim.groupBy(*B.PAGE).agg(F.first("rtl").alias("rtl"), F.array_sort(F.collect_list("b")).alias("b"))

    @F.arrow_udf("array<int>")
    def order(x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array, rtl: pa.Array) -> pa.Array:
        starts = arrays.lists(x0)[0]
        boxes = np.stack([arrays.numbers(c.flatten()) for c in (x0, y0, x1, y1)], 1)
        right = pc.fill_null(rtl, False).to_numpy(zero_copy_only=False).astype(bool)
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(xy_cuts(starts, boxes, right, cfg), pa.int32()))

    side = lambda c: F.col("b")[c]
    ids = order(*(side(c) for c in ("x0", "y0", "x1", "y1")), F.col("rtl"))
    placed = packed.select(*B.PAGE, F.col("b")["block_id"].alias("names"), ids.alias("ids"))
    return placed.select(*B.PAGE, "names", F.posexplode("ids").alias("place", "i")).select(*B.PAGE, F.get("names", F.col("i")).alias("block_id"), "place")


def band_key(cfg: EngineConfig, page_height: Column) -> Column:
    high = F.when(page_height > 0, page_height / cfg.bands).otherwise(1.0)
    return F.least(F.lit(cfg.bands - 1), F.coalesce(((F.col("bbox.y0") + F.col("bbox.y1")) / 2 / high).cast("int"), F.lit(0)))


def band_order(blocks: DataFrame, pages: DataFrame, directions: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """block_id and place by horizontal bands, left to right or right to left inside each."""
    on = blocks.join(pages.select(*B.PAGE, F.col("height").alias("page_height")), list(B.PAGE)).join(directions, "doc_id")
    x = F.coalesce("bbox.x0", F.lit(0.0))
    w = Window.partitionBy(*B.PAGE).orderBy(band_key(cfg, F.col("page_height")), F.when(F.col("rtl"), -x).otherwise(x), "seq", "block_id")
    return on.select(*B.PAGE, "block_id", (F.row_number().over(w) - 1).cast("int").alias("place"))


def directions(blocks: DataFrame) -> DataFrame:
    """doc_id and rtl: whether more than half of its blocks run right to left."""
    return blocks.groupBy("doc_id").agg((F.avg(F.when(F.col("script_direction") == "rtl", 1.0).otherwise(0.0)) > 0.5).alias("rtl"))


def coherence(blocks: DataFrame, pages: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """order_quality of each page: how many neighbours in one column run downwards."""
    w = Window.partitionBy(*B.PAGE).orderBy("seq")
    box = F.col("bbox")
    nxt = F.lead("bbox").over(w)
    same = F.abs((box["x0"] + box["x1"]) / 2 - (nxt["x0"] + nxt["x1"]) / 2) < cfg.column_shift * F.col("page_width")
    ok = F.when(box.isNull() | nxt.isNull(), 0).when(~same | (nxt["y0"] >= box["y0"]), 1).otherwise(0)
    rows = blocks.join(pages.select(*B.PAGE, F.col("width").alias("page_width")), list(B.PAGE))
    pairs = rows.withColumn("last", F.lead("seq").over(w).isNull()).withColumn("ok", ok)
    n, good = F.count("*"), F.sum(F.when(~F.col("last"), F.col("ok")).otherwise(0))
    return pairs.groupBy(*B.PAGE).agg(F.when(n <= 1, 0.95).otherwise(0.5 + 0.45 * F.try_divide(good, n - 1)).alias("order_quality"))


def run(pages: DataFrame, blocks: DataFrame, strategy: str = "xy_cut", cfg: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(pages, blocks) in reading order; a page's own order_strategy wins over the argument."""
    own = F.col("order_strategy") if "order_strategy" in pages.columns else F.lit(None).cast("string")
    pages = pages.withColumn("order_strategy", F.coalesce(F.nullif(own, F.lit("")), F.lit(strategy)))
    told = directions(blocks)
    chosen = blocks.join(pages.select(*B.PAGE, "order_strategy"), list(B.PAGE))
    placed = xy_order(chosen.where("order_strategy <> 'band_based'"), told, cfg).unionByName(band_order(chosen.where("order_strategy = 'band_based'"), pages, told, cfg))
    ordered = blocks.join(placed.select("doc_id", "page_num", "block_id", "place"), ["doc_id", "page_num", "block_id"]).withColumn("seq", F.col("place")).select(*B.COLUMNS)
    q = coherence(ordered, pages, cfg)
    out = ordered.join(q, list(B.PAGE))
    return pages, B.with_confidence(out, order_quality=F.col("order_quality")).select(*B.COLUMNS)
