"""Rectangles, intervals and page rasters as column expressions (points, origin top left)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.config import DEFAULT
from quire.functions.arrays import union_area  # noqa: F401


def bbox(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for n, c in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))))


def width(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def area(b: Column) -> Column:
    return width(b) * height(b)


def intersects(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (a["x1"] > b["x0"]) & (a["y0"] < b["y1"]) & (a["y1"] > b["y0"])


def intersection(a: Column, b: Column) -> Column:
    """Null where the two do not intersect."""
    return F.when(intersects(a, b), bbox(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"])))


def overlap_area(a: Column, b: Column) -> Column:
    across = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    down = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return across * down


def overlap_share(a: Column, b: Column) -> Column:
    """Share of a that b covers; null for an empty a."""
    return F.try_divide(overlap_area(a, b), F.nullif(area(a), F.lit(0.0)))


def contained(inner: Column, outer: Column, pad: float = DEFAULT.caption_pad) -> Column:
    return (inner["x0"] >= outer["x0"] - pad) & (inner["y0"] >= outer["y0"] - pad) & (inner["x1"] <= outer["x1"] + pad) & (inner["y1"] <= outer["y1"] + pad)


def center(b: Column) -> tuple[Column, Column]:
    return (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2


def center_inside(inner: Column, outer: Column) -> Column:
    x, y = center(inner)
    return x.between(outer["x0"], outer["x1"]) & y.between(outer["y0"], outer["y1"])


def scaled(b: Column, by: Column) -> Column:
    return bbox(*(b[k] * by for k in ("x0", "y0", "x1", "y1")))


def from_pixels(b: Column, dpi: Column) -> Column:
    return scaled(b, F.lit(72.0) / F.greatest(dpi, F.lit(1)))


def clamped(b: Column, w: Column, h: Column) -> Column:
    hold = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top))
    return bbox(hold(b["x0"], w), hold(b["y0"], h), hold(b["x1"], w), hold(b["y1"], h))


def upright(b: Column) -> Column:
    return bbox(F.least(b["x0"], b["x1"]), F.least(b["y0"], b["y1"]), F.greatest(b["x0"], b["x1"]), F.greatest(b["y0"], b["y1"]))


def of_matrix(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    """Bounding box of the unit square under an affine matrix."""
    xs, ys = (e, e + a, e + c, e + a + c), (f, f + b, f + d, f + b + d)
    return bbox(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def image_boxes(boxes: Column, w: Column, h: Column) -> Column:
    """Upright boxes clipped to the page, without those that come out empty."""
    return F.filter(F.transform(boxes, lambda b: clamped(upright(b), w, h)), lambda b: (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]))


def line_height(b: Column, text: Column) -> Column:
    """Height of one line of a block; 0 without a box."""
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return F.coalesce(height(b) / lines, F.lit(0.0))


def told(b: Column) -> Column:
    """The box as text, one decimal."""
    return F.format_string("BBox(%.1f, %.1f, %.1f, %.1f)", b["x0"], b["y0"], b["x1"], b["y1"])


def inscribed(w: Column, h: Column, radians: Column) -> Column:
    """(width, height) of the largest upright rectangle inside a w x h image that was turned."""
    turn = F.pmod(F.abs(radians), F.lit(math.pi))
    turn = F.when(turn > math.pi / 2, math.pi - turn).otherwise(turn)
    c, s = F.cos(turn), F.sin(turn)
    whole = lambda v: v.cast("int")
    square = whole(w * (c - s))
    tall = whole(h / (c + s * h / w))
    wide = whole(w / (c + s * w / h))
    pair = lambda a, b: F.struct(a.cast("int").alias("width"), b.cast("int").alias("height"))
    return F.when((w <= 0) | (h <= 0), pair(w, h)).when(w == h, pair(square, square)).when(h * s <= w * c, pair(whole(tall * w / h), tall)).otherwise(pair(wide, whole(wide * h / w)))


def raster_dpi(w: Column, h: Column, dpi: int = DEFAULT.ocr_dpi, most: int = DEFAULT.raster_bytes, least: int = DEFAULT.least_dpi) -> Column:
    """Resolution at which an RGB raster of a w x h point page fits, halved from dpi down to `least`."""
    steps = [dpi]
    while steps[-1] > least:
        steps.append(max(least, steps[-1] // 2))
    size = lambda d: F.floor(w * d / 72.0) * F.floor(h * d / 72.0) * 3
    out = F.lit(steps[-1])
    for d in reversed(steps[:-1]):
        out = F.when(size(d) <= most, d).otherwise(out)
    return out
