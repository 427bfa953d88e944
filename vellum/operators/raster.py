"""Pixel operators: thresholds as relations, score maps, and labelled components in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.operators import layout
from vellum.operators.batches import over_images


def grey(b: Column, g: Column, r: Column) -> Column:
    return F.round(0.114 * b + 0.587 * g + 0.299 * r).cast("int")


def invert_dark(pixels: DataFrame) -> DataFrame:
    """Values of dark images (mean under 127) turned over."""
    return pixels.withColumn("v", F.when(F.avg("v").over(W.partitionBy("image_id")) < 127, 255 - F.col("v")).otherwise(F.col("v")))


def otsu(pixels: DataFrame) -> DataFrame:
    """(image_id, threshold): the first value that parts the histogram with the largest between-class variance. Pixels
    are counted by value before anything moves, so at most 256 rows an image meet."""
    hist = pixels.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    upto, all_ = W.partitionBy("image_id").orderBy("v").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("image_id")
    h = hist.withColumns({"n0": F.sum("n").over(upto), "s0": F.sum(F.col("n") * F.col("v")).over(upto), "n": F.sum("n").over(all_), "s": F.sum(F.col("n") * F.col("v")).over(all_)})
    n1, m = F.col("n") - F.col("n0"), F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / (F.col("n") - F.col("n0"))
    h = h.withColumn("between", F.when(n1 > 0, F.col("n0") * n1.cast("double") * m * m).otherwise(0.0))
    return h.withColumn("rank", F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("between"), "v"))).where("rank = 1").select("image_id", F.col("v").alias("threshold"))


def region_map(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, px, py, value): a bell for each character box over the box grown by a fifth; the largest counts.
    A box without a number among x, y, w and h, or beyond the page, has no pixels."""
    sx, sy = F.greatest(F.col("w") / 2.5, F.lit(1.0)), F.greatest(F.col("h") / 2.5, F.lit(1.0))
    gx, gy = (F.col("w") * 0.2).cast("int"), (F.col("h") * 0.2).cast("int")
    x = F.sequence(F.greatest(F.lit(0), F.col("x") - gx), F.least(F.lit(width), F.col("x") + F.col("w") + gx) - 1)
    y = F.sequence(F.greatest(F.lit(0), F.col("y") - gy), F.least(F.lit(height), F.col("y") + F.col("h") + gy) - 1)
    p = boxes.dropna(subset=list("xywh")).where((F.array_min(x) == x[0]) & (F.array_min(y) == y[0])).withColumn("px", F.explode(x)).withColumn("py", F.explode(y))
    value = G.gaussian(F.col("px") - (F.col("x") + F.col("w") / 2), F.col("py") - (F.col("y") + F.col("h") / 2), sx, sy)
    return p.groupBy("image_id", "px", "py").agg(F.max(value).alias("value"))


#: Pixels under boxes that are laid out at once in numpy.
PIXELS = 1 << 21


class Map(NamedTuple):
    """The region maps of a batch's images: one entry a pixel in order of image (its place in the batch), row and column."""

    width: int
    height: int
    key: np.ndarray
    value: np.ndarray

    @property
    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Image, px and py of each pixel."""
        image, at = np.divmod(self.key, self.width * self.height)
        return image, at % self.width, at // self.width

    def under(self, image: np.ndarray, box: np.ndarray, px: np.ndarray, py: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """How many of the given pixels of each of ``n`` boxes are in the map, and the sum of their values."""
        key = image * (self.width * self.height) + py * self.width + px
        at = np.searchsorted(self.key, key)
        found = at < len(self.key)
        found[found] = self.key[at[found]] == key[found]
        return np.bincount(box[found], minlength=n), np.bincount(box[found], self.value[at[found]], minlength=n)


def laid_out(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Box, px and py of every pixel of boxes (ends excluded), some boxes at a time; one without area has none."""
    wide = np.maximum(0, x1 - x0)
    n = wide * np.maximum(0, y1 - y0)
    upto = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - n[lo] + PIXELS, "right")))
        box = np.repeat(np.arange(lo, hi), n[lo:hi])
        k = np.arange(len(box)) - (upto[box] - n[box] - (upto[lo] - n[lo]))
        yield box, x0[box] + k % wide[box], y0[box] + k // wide[box]
        lo = hi


def bells(image: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, width: int, height: int) -> Map:
    """See region_map. Pixels are merged whenever some are laid out, so no more is held than the maps and PIXELS."""
    sx, sy = np.maximum(w / 2.5, 1.0), np.maximum(h / 2.5, 1.0)
    gx, gy = (w * 0.2).astype(np.int64), (h * 0.2).astype(np.int64)
    cx, cy = x + w / 2, y + h / 2
    keys, values = np.zeros(0, np.int64), np.zeros(0)
    for box, px, py in laid_out(np.maximum(0, x - gx), np.maximum(0, y - gy), np.minimum(width, x + w + gx), np.minimum(height, y + h + gy)):
        dx, dy, a, b = px - cx[box], py - cy[box], sx[box], sy[box]
        k = np.concatenate([keys, image[box] * (width * height) + py * width + px])
        v = np.concatenate([values, np.exp(-(dx * dx / (2 * a * a) + dy * dy / (2 * b * b)))])
        if not len(k):
            continue
        order = np.argsort(k)
        k = k[order]
        first = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
        keys, values = k[first], np.maximum.reduceat(v[order], first)
    return Map(width, height, keys, values)


def over_maps(boxes: DataFrame, width: int, height: int, work: Callable[[pa.Table, np.ndarray, np.ndarray, Map], pa.Table], schema: str, places: int = 9) -> DataFrame:
    """``work`` over tables of whole images' boxes, the place of each row's image, which rows have no null among x, y, w and h,
    and the images' region maps, whose values are rounded. Boxes move once, by image; pixels never do."""

    def run(t: pa.Table, at: np.ndarray) -> pa.Table:
        image = np.repeat(np.arange(len(at) - 1), np.diff(at))
        whole = np.logical_and.reduce([t[k].is_valid().to_numpy() for k in "xywh"])
        x, y, w, h = (t[k].fill_null(0).to_numpy().astype(np.int64)[whole] for k in "xywh")
        m = bells(image[whole], x, y, w, h, width, height)
        return work(t, image, whole, m._replace(value=np.round(m.value, places)))

    return over_images(boxes, [], run, schema)


def named(t: pa.Table, image: np.ndarray, which: np.ndarray) -> pa.ChunkedArray:
    """The ids of images given by their places in the batch."""
    places, first = np.unique(image, return_index=True)
    return t["image_id"].take(pa.array(first[np.searchsorted(places, which)]))


def id_type(boxes: DataFrame, name: str = "image_id") -> str:
    return boxes.schema[name].dataType.simpleString()


def quad_map_scores(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, box_id, score): quad_scores of the boxes' quads (whole-numbered points, of some area) on their images' region
    map."""

    def work(t: pa.Table, image: np.ndarray, whole: np.ndarray, m: Map) -> pa.Table:
        corners = t["points"].combine_chunks().flatten()
        qx, qy = (corners.field(k).fill_null(0).to_numpy().astype(np.int64).reshape(-1, 4) for k in "xy")
        n, total = np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows)
        dx, dy = (np.ascontiguousarray((np.roll(q, -1, axis=1) - q).T) for q in (qx, qy))
        least = np.ascontiguousarray(dx * qy.T - dy * qx.T)
        for box, px, py in laid_out(np.maximum(0, qx.min(axis=1)), np.maximum(0, qy.min(axis=1)), np.minimum(width, qx.max(axis=1) + 1), np.minimum(height, qy.max(axis=1) + 1)):
            for k in range(4):
                inside = np.flatnonzero(dx[k][box] * py - dy[k][box] * px >= least[k][box])
                box, px, py = box[inside], px[inside], py[inside]
            got = m.under(image[box], box, px, py, t.num_rows)
            n, total = n + got[0], total + got[1]
        return pa.table([t["image_id"], t["box_id"], pa.array(np.where(whole, total / np.maximum(n, 1), 0.0))], names=["image_id", "box_id", "score"])

    chosen = boxes.select("image_id", "box_id", *"xywh", "points")
    return over_maps(chosen, width, height, work, f"image_id {id_type(boxes)}, box_id {id_type(boxes, 'box_id')}, score double")


def box_map_scores(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, box_id, score): box_scores of the boxes on their own images' region map."""

    def work(t: pa.Table, image: np.ndarray, whole: np.ndarray, m: Map) -> pa.Table:
        x, y, w, h = (t[k].fill_null(0).to_numpy().astype(np.int64) for k in "xywh")
        n, total = np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows)
        for box, px, py in laid_out(np.maximum(0, x), np.maximum(0, y), np.minimum(width, x + w), np.minimum(height, y + h)):
            got = m.under(image[box], box, px, py, t.num_rows)
            n, total = n + got[0], total + got[1]
        return pa.table([t["image_id"], t["box_id"], pa.array(total / np.maximum(n, 1))], names=["image_id", "box_id", "score"]).filter(pa.array(whole & (n > 0)))

    chosen = boxes.select("image_id", "box_id", *"xywh")
    return over_maps(chosen, width, height, work, f"image_id {id_type(boxes)}, box_id {id_type(boxes, 'box_id')}, score double")


def map_columns(boxes: DataFrame, width: int, height: int, threshold: float) -> DataFrame:
    """(image_id, px, top, bottom): column_extents of the pixels of the boxes' region maps over a threshold."""

    def work(t: pa.Table, image: np.ndarray, whole: np.ndarray, m: Map) -> pa.Table:
        on = m.value > threshold
        of, px, py = (v[on] for v in m.places)
        order = np.argsort(of * width + px, kind="stable")  # rows stay in order within a column
        of, px, py = of[order], px[order], py[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (px[1:] != px[:-1])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(of)]])[: len(first)] - 1
        first, last = first[last > first], last[last > first]
        return pa.table([named(t, image, of[first]), *(pa.array(v, pa.int32()) for v in (px[first], py[first], py[last]))], names=["image_id", "px", "top", "bottom"])

    return over_maps(boxes.select("image_id", *"xywh"), width, height, work, f"image_id {id_type(boxes)}, px int, top int, bottom int")


def map_totals(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, n, total, top): number, sum and largest of the values of each image's region map."""

    def work(t: pa.Table, image: np.ndarray, whole: np.ndarray, m: Map) -> pa.Table:
        of = m.places[0]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        n = np.diff(first, append=len(of))
        fold = lambda f: f.reduceat(m.value, first) if len(first) else np.zeros(0)
        return pa.table([named(t, image, of[first]), pa.array(n, pa.int64()), pa.array(fold(np.add)), pa.array(fold(np.maximum))], names=["image_id", "n", "total", "top"])

    return over_maps(boxes.select("image_id", *"xywh"), width, height, work, f"image_id {id_type(boxes)}, n bigint, total double, top double")


def affinity_pairs(chars: DataFrame, dy: int = 20, widths: float = 3.0) -> DataFrame:
    """Neighbours in order whose centres are on one line and near: (image_id, box_id, next_id, mid_x, mid_y, w, h)."""
    w = W.partitionBy("image_id").orderBy("box_id")
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    b = chars.withColumns({"cx": cx, "cy": cy}).withColumns({"n_id": F.lead("box_id").over(w), "n_cx": F.lead("cx").over(w), "n_cy": F.lead("cy").over(w), "n_w": F.lead("w").over(w), "n_h": F.lead("h").over(w)})
    near = (F.abs(F.col("cy") - F.col("n_cy")) <= dy) & (F.abs(F.col("n_cx") - F.col("cx")) <= widths * (F.col("w") + F.col("n_w")) / 2)
    return b.where(F.col("n_id").isNotNull() & near).select("image_id", "box_id", F.col("n_id").alias("next_id"), ((F.col("cx") + F.col("n_cx")) / 2).alias("mid_x"), ((F.col("cy") + F.col("n_cy")) / 2).alias("mid_y"), F.abs(F.col("n_cx") - F.col("cx")).alias("w"), ((F.col("h") + F.col("n_h")) / 2).alias("h"))


def box_scores(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Mean value under each axis-aligned box. Boxes are dealt to the rows they cover, pixels come with theirs."""
    b = boxes.select("image_id", "box_id", "x", "w", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1)).alias("py"))
    return pixels.join(b, ["image_id", "py"]).where((F.col("px") >= F.col("x")) & (F.col("px") < F.col("x") + F.col("w"))).groupBy("image_id", "box_id").agg(F.avg("value").alias("score"))


def quad_scores(pixels: DataFrame, quads: DataFrame) -> DataFrame:
    """Mean value under each convex quad (points, clockwise on the screen), its edges included; 0 where no pixel is."""
    p = F.col("points")
    ys = F.transform(p, lambda q: q["y"])
    rows = quads.withColumn("py", F.explode(F.sequence(F.ceil(F.array_min(ys)).cast("int"), F.floor(F.array_max(ys)).cast("int"))))
    edge = lambda i: F.struct(p[i].alias("a"), p[(i + 1) % 4].alias("b"))
    x, y = F.col("px"), F.col("py")
    right = lambda e: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"]) >= 0
    under = pixels.join(rows, ["image_id", "py"]).where(F.forall(F.array(*map(edge, range(4))), right)).groupBy("image_id", "box_id").agg(F.avg("value").alias("score"))
    return quads.select("image_id", "box_id").join(under, ["image_id", "box_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def column_extents(pixels: DataFrame) -> DataFrame:
    """(image_id, px, top, bottom) of the columns with two pixels or more."""
    return pixels.groupBy("image_id", "px").agg(F.min("py").alias("top"), F.max("py").alias("bottom"), F.count("*").alias("n")).where("n >= 2").drop("n")


def segments(extents: DataFrame, width: int, points: int = 5) -> DataFrame:
    """(image_id, segment, cx, cy, pivot_x, pivot_y, height, median_height): a word's columns in 2 * ``points`` + 1 parts of
    its width, each with its mean centre; of the odd ones the tallest column (the first of equals) is a pivot of the
    curved outline, and half the pivots' median height, widened, its reach."""
    parts = 2 * points + 1
    cy, height = (F.col("top") + F.col("bottom")) * 0.5, F.col("bottom") - F.col("top") + 1
    e = extents.withColumns({"mid": cy, "height": height, "segment": F.least(F.lit(parts - 1), F.floor(F.col("px") / (width / parts)).cast("int"))})
    best = F.max(F.struct("height", (-F.col("px")).alias("x"), "mid"))
    g = e.groupBy("image_id", "segment").agg(F.avg("px").alias("cx"), F.avg("mid").alias("cy"), best.alias("best"))
    odd = F.col("segment") % 2 == 1
    g = g.select("image_id", "segment", "cx", "cy", F.when(odd, -F.col("best.x")).alias("pivot_x"), F.when(odd, F.col("best.mid")).alias("pivot_y"), F.when(odd, F.col("best.height")).alias("height"))
    return g.withColumn("median_height", F.median("height").over(W.partitionBy("image_id")))


def across(axis: str, other: str) -> W:
    """A line of pixels along ``axis``; all of an image's lines are in the partition of its id."""
    return W.partitionBy("image_id", other).orderBy(axis)


def box_sum(pixels: DataFrame, value: str, radius: int) -> DataFrame:
    """Adds ``total``: the sum over the square of ``radius`` around each pixel, border pixels repeated beyond the border."""
    out = pixels.repartition("image_id").withColumn("total", F.col(value))
    for axis, other in (("px", "py"), ("py", "px")):
        line = W.partitionBy("image_id", other).orderBy(axis)
        whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        near = F.sum("total").over(line.rowsBetween(-radius, radius))
        before, after = F.greatest(F.lit(0), radius - F.col(axis)), F.greatest(F.lit(0), radius - (F.max(axis).over(whole) - F.col(axis)))
        out = out.withColumn("total", near + before * F.first("total").over(whole) + after * F.last("total").over(whole))
    return out


def mean_threshold(pixels: DataFrame, block: int, offset: int) -> DataFrame:
    """Adds ``on``: whether a pixel (image_id, px, py, v) is brighter than the mean of its ``block`` x ``block`` surroundings,
    rounded, less ``offset``."""
    mean = F.bround(F.col("total") / float(block * block)).cast("int")
    return box_sum(pixels, "v", block // 2).withColumn("on", F.col("v") > mean - offset).drop("total")


def reflected(value: str, axis: str, other: str) -> tuple[Column, Column]:
    """The pixels before and after; at the border the one on the other side stands in."""
    line = across(axis, other)
    before, after = F.lag(value).over(line), F.lead(value).over(line)
    return F.coalesce(before, after), F.coalesce(after, before)


def sobel(pixels: DataFrame) -> DataFrame:
    """Adds gx and gy (3 x 3), and the magnitude scaled so that the image's largest is 255."""
    up, down = reflected("v", "py", "px")
    left, right = reflected("v", "px", "py")
    p = pixels.repartition("image_id").withColumns({"smooth_y": up + 2 * F.col("v") + down, "smooth_x": left + 2 * F.col("v") + right})
    l, r = reflected("smooth_y", "px", "py")
    u, d = reflected("smooth_x", "py", "px")
    p = p.withColumns({"gx": r - l, "gy": d - u}).drop("smooth_x", "smooth_y")
    size = F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double"))
    top = F.max(size).over(W.partitionBy("image_id"))
    return p.withColumn("magnitude", F.when(top > 0, F.floor(size / top * 255)).otherwise(0).cast("int"))


def morphological_gradient(pixels: DataFrame) -> DataFrame:
    """Adds ``edge``: the largest less the smallest value of a pixel and its four neighbours."""
    near = [F.col("v")] + [f("v").over(across(a, b)) for f in (F.lag, F.lead) for a, b in (("px", "py"), ("py", "px"))]
    return pixels.repartition("image_id").withColumn("edge", F.greatest(*near) - F.least(*near))


def saturation(b: Column, g: Column, r: Column) -> tuple[Column, Column]:
    """Value and saturation of a colour, both up to 255."""
    v, low = F.greatest(b, g, r), F.least(b, g, r)
    return v, F.when(v > 0, F.round((v - low) * 255 / v)).otherwise(0).cast("int")


def label(mask: np.ndarray, eight: bool = True) -> np.ndarray:
    """Component numbers from 1, in order of each one's first pixel; 0 is background."""
    h, w = mask.shape
    parent = np.arange(h * w)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if eight else [])]
    for dy, dx in steps:
        ys, xs = np.nonzero(mask[: h - dy, max(0, -dx) : w - max(0, dx)] & mask[dy:, max(0, dx) : w + min(0, dx)])
        xs = xs + max(0, -dx)
        for a, b in zip((ys * w + xs).tolist(), ((ys + dy) * w + xs + dx).tolist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    roots = np.array([find(i) for i in range(h * w)]).reshape(h, w)
    out = np.zeros((h, w), int)
    for n, r in enumerate(np.unique(roots[mask]), 1):
        out[(roots == r) & mask] = n
    return out


def components(images: DataFrame, threshold: float, eight: bool = True) -> DataFrame:
    """(image_id, component, x, y, w, h, area, cx, cy, top) of images (image_id, width, height, values row by row)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for image, w, h, values in zip(b["image_id"], b["width"], b["height"], b["values"], strict=True):
                v = np.asarray(values, float).reshape(h, w)
                lab = label(v > threshold, eight)
                for n in range(1, int(lab.max(initial=0)) + 1):
                    ys, xs = np.nonzero(lab == n)
                    out.append((image, n, int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1, len(xs), float(xs.mean()), float(ys.mean()), float(v[ys, xs].max())))
            yield pd.DataFrame(out, columns=["image_id", "component", "x", "y", "w", "h", "area", "cx", "cy", "top"])

    return images.select("image_id", "width", "height", "values").mapInPandas(run, "image_id int, component int, x int, y int, w int, h int, area int, cx double, cy double, top double")


def score_map_boxes(images: DataFrame, low: float = 0.4, text: float = 0.7, least_area: int = 10) -> DataFrame:
    """Components of a score map (4-connected) of enough area and score, widened as the map's blur asks."""
    c = components(images, low, eight=False).where((F.col("area") >= least_area) & (F.col("top") >= text))
    grow = F.floor(F.sqrt(F.col("area") * F.least("w", "h") / (F.col("w") * F.col("h"))) * 2).cast("int")
    return c.withColumn("grow", grow).select("image_id", "component", F.greatest(F.lit(0), F.col("x") - F.col("grow")).alias("x"), F.greatest(F.lit(0), F.col("y") - F.col("grow")).alias("y"), (F.col("w") + 2 * F.col("grow")).alias("w"), (F.col("h") + 2 * F.col("grow")).alias("h"), "area", "top")


def score_boxes(images: DataFrame, width: int, height: int, to_width: int, to_height: int, low: float = 0.3, threshold: float = 0.5, min_size: int = 3, ratio: float = 1.6) -> DataFrame:
    """Boxes of a probability map (8-connected components over ``low``), by their mean score, moved outwards and scaled to the
    image; see layout.contour_boxes. A component of one row or column has no outline of four points."""
    c = components(images, low).select("image_id", F.col("component").alias("box_id"), *"xywh")
    pixels = images.select("image_id", "width", F.posexplode("values").alias("i", "value")).select("image_id", (F.col("i") % F.col("width")).alias("px"), F.floor(F.col("i") / F.col("width")).cast("int").alias("py"), "value")
    scored = c.join(box_scores(pixels, c), ["image_id", "box_id"]).withColumn("score", F.round("score", 9))
    contours = scored.withColumn("points", F.when((F.col("w") > 1) & (F.col("h") > 1), 4).otherwise(2)).withColumnRenamed("box_id", "contour")
    return layout.contour_boxes(contours, width, height, to_width, to_height, min_size, threshold, ratio)
