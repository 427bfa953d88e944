"""Page layout: filters, suppression, lines, words, blocks, merges, padding and hierarchy of boxes.

All work within an image, so one exchange on image_id serves them. What folds over an image's boxes in order, or holds each
against all, runs in Arrow batches of whole images.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from vellum.functions import geometry as G
from vellum.operators.batches import by_image, in_order, over_images


def image() -> W:
    return W.partitionBy("image_id")


def filter_components(boxes: DataFrame, width: int, height: int, min_w: int = 2, min_h: int = 6, max_h: int | None = None) -> DataFrame:
    """Plausible sizes first, then heights within 0.15 and 5 times the survivors' median height."""
    max_h = int(0.5 * height) if max_h is None else max_h
    edge = (F.col("x") <= 0) | (F.col("y") <= 0) | (F.col("x") + F.col("w") >= width) | (F.col("y") + F.col("h") >= height)
    ratio = F.col("w") / F.col("h")
    first = boxes.where((F.col("w") >= min_w) & (F.col("h") >= min_h) & (F.col("h") <= max_h) & (F.col("w") <= 0.98 * width) & ratio.between(0.02, 50) & ~(edge & ((F.col("w") > 0.5 * width) | (F.col("h") > 0.5 * height))))
    return first.withColumn("m", F.median("h").over(image())).where((F.col("h") >= 0.15 * F.col("m")) & (F.col("h") <= 5 * F.col("m"))).drop("m")


def text_metrics(boxes: DataFrame) -> DataFrame:
    """Median sizes and the padding derived from them, for each image."""
    return boxes.groupBy("image_id").agg(F.median("h").alias("median_h"), F.median("w").alias("median_w"), F.stddev_pop("h").alias("std_h")).withColumn("padding", F.greatest(F.lit(2), (F.lit(0.15) * F.col("median_h")).cast("int")))


def binarisation_score(boxes: DataFrame, height: int) -> DataFrame:
    """How text-like a set of components is: share that is, evenness of heights, size and aspect factors; 0 under 3."""
    good = G.text_like(F.col("w"), F.col("h"), F.col("w") * F.col("h") * 0.6, F.lit(height))
    kept = boxes.where(good).groupBy("image_id").agg(F.count("*").alias("n"), F.median("h").alias("mh"), F.stddev_pop("h").alias("sh"), F.median(F.col("w") / F.col("h")).alias("mar"))
    size, shape = F.when(F.col("mh").between(8, 100), 1.0).otherwise(0.5), F.when((F.col("mar") > 0.3) & (F.col("mar") < 3), 1.0).otherwise(0.5)
    score = F.when(F.col("n") < 3, 0.0).otherwise(F.col("n") * (1 / (1 + F.col("sh") / F.greatest(F.col("mh"), F.lit(1.0)))) * size * shape)
    return kept.select("image_id", "n", score.alias("score"))


def component_confidence(score: Column, w: Column, h: Column, area: Column) -> Column:
    """min(1, score * aspect factor * fill factor / 100)."""
    ar, fl = w / h, G.fill(area, w, h)
    return F.least(F.lit(1.0), score * F.when((ar > 0.2) & (ar < 5), 1.0).otherwise(0.5) * F.when((fl > 0.2) & (fl < 0.9), 1.0).otherwise(0.5) * 0.01)


def union_candidates(found: list[tuple[str, float, DataFrame]]) -> DataFrame:
    """All components of several methods and scales, in the image's coordinates, with their ``source``: (name, scale of the
    image that the method saw, its components)."""
    out = None
    for name, scale, boxes in found:
        at = boxes if scale == 1.0 else boxes.withColumns(G.rescale(1.0 / scale))
        at = at.select("image_id", "x", "y", "w", "h", F.col("confidence").cast("double").alias("confidence"), F.lit(name).alias("source"))
        out = at if out is None else out.unionByName(at)
    return out


def text_boxes(boxes: DataFrame, level: str = "character", confidence: float | None = None) -> DataFrame:
    """Components as text boxes of a level, without children; a fixed confidence stands in for theirs if one is given."""
    score = F.col("confidence").cast("double") if confidence is None else F.lit(confidence)
    return boxes.select("image_id", *(["box_id"] if "box_id" in boxes.columns else []), "x", "y", F.col("w").alias("width"), F.col("h").alias("height"), score.alias("confidence"), F.lit(level).alias("level"), F.array().cast("array<int>").alias("children"))


def described(x="x", y="y", w="w", h="h", confidence="confidence") -> Column:
    """A box as one line of text, its confidence with two decimals."""
    return F.format_string("TextBox(%d, %d, %d, %d, conf=%.2f)", *map(F.col, (x, y, w, h, confidence)))


def multiline(lines: DataFrame, least: int = 2) -> DataFrame:
    """(image_id, lines, is_multiline) by the number of an image's lines."""
    return lines.groupBy("image_id").agg(F.count("*").alias("lines")).withColumn("is_multiline", F.col("lines") >= least)


def contour_boxes(contours: DataFrame, width: int, height: int, to_width: int, to_height: int, min_size: int = 3, threshold: float = 0.5, ratio: float = 1.6, first: int = 1000) -> DataFrame:
    """Boxes of the first ``first`` contours of an image (image_id, contour, points, x, y, w, h, score): four points, short
    side and score large enough, moved outwards, the short side then ``min_size`` + 2 at least; scaled from a map of
    ``width`` x ``height`` to the image and cut at its edges."""
    c = contours.withColumn("rank", F.row_number().over(image().orderBy("contour"))).where(F.col("rank") <= first)
    c = c.where((F.col("points") >= 4) & (F.least("w", "h") >= min_size) & (F.col("score") >= threshold))
    d = F.col("w") * F.col("h") * F.lit(ratio) / (2.0 * (F.col("w") + F.col("h")))
    c = c.withColumn("d", F.when((F.col("w") > 0) & (F.col("h") > 0), d)).where(F.least("w", "h") + 2 * F.col("d") >= min_size + 2)
    cut = lambda v, size, to: F.least(F.lit(float(to)), F.greatest(F.lit(0.0), v / F.lit(float(size)) * to)).cast("int")
    d = F.col("d")
    return c.select("image_id", "contour", cut(F.col("x") - d, width, to_width).alias("x1"), cut(F.col("y") - d, height, to_height).alias("y1"), cut(F.col("x") + F.col("w") + d, width, to_width).alias("x2"), cut(F.col("y") + F.col("h") + d, height, to_height).alias("y2"), "score")


def zip_detections(found: DataFrame, boxes_col: str = "boxes", scores_col: str = "scores") -> DataFrame:
    """(image_id, line_number, box, det_confidence): an image's boxes and confidences by their place, from 1; a missing
    confidence is null."""
    return found.select("image_id", F.posexplode(F.arrays_zip(F.col(boxes_col).alias("box"), F.col(scores_col).alias("det_confidence"))).alias("pos", "z")).select("image_id", (F.col("pos") + 1).alias("line_number"), "z.box", "z.det_confidence")


def numbered(regions: DataFrame, order: list[str]) -> DataFrame:
    """Regions numbered from 1 in order, those that failed or are empty then left out: their numbers stay gaps."""
    r = regions.withColumn("line_number", F.row_number().over(image().orderBy(*order)))
    return r.where(F.col("error").isNull() & (F.length("text") > 0))


def character_boxes(lines: DataFrame, widths: DataFrame, x: int = 0, height: int = 20) -> DataFrame:
    """(line_id, pos, char, x1, y1, x2, y2): boxes of a line's characters one after the other, by the glyph widths (char,
    width; all of one font). White space moves on by its width, 3 at least (5 where it has none), and has no box; a
    character without a width has neither."""
    c = lines.select("line_id", "y", F.posexplode(F.filter(F.split("text", ""), lambda v: v != "")).alias("pos", "char")).join(widths, "char", "left")
    blank = F.col("char").rlike(r"^\s$")
    move = F.when(blank, F.coalesce(F.greatest(F.col("width"), F.lit(3)), F.lit(5))).otherwise(F.coalesce("width", F.lit(0)))
    at = F.lit(x) + F.coalesce(F.sum(move).over(W.partitionBy("line_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return c.withColumn("x1", at.cast("int")).where(~blank & (F.col("width") > 0)).select("line_id", "pos", "char", "x1", F.col("y").alias("y1"), (F.col("x1") + F.col("width")).alias("x2"), (F.col("y") + height).alias("y2"))


def top_candidates(scores: DataFrame, k: int = 3) -> DataFrame:
    """The k best candidates of each image with a positive score."""
    return scores.where("score > 0").withColumn("rank", F.row_number().over(image().orderBy(F.desc("score"), "candidate"))).where(F.col("rank") <= k)


#: Boxes that meet all of an image's boxes at once in numpy, so that temporaries of dense images stay small.
BLOCK = 512


def suppress(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Greedy suppression: by confidence, ties by box_id, a box goes if it overlaps a kept one by more than the threshold."""

    def over(lo: int, hi: int, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
        iw = np.minimum(x2[lo:hi, None], x2) - np.maximum(x1[lo:hi, None], x1)
        ih = np.minimum(y2[lo:hi, None], y2) - np.maximum(y1[lo:hi, None], y1)
        area, inter = (x2 - x1) * (y2 - y1), iw * ih
        union = area[lo:hi, None] + area - inter
        return (iw > 0) & (ih > 0) & (union > 0) & (inter / np.where(union > 0, union, 1) > threshold)

    def work(t: pa.Table, at: np.ndarray) -> pa.Table:
        x, y, w, h = (t[k].to_numpy().astype(np.int64) for k in "xywh")
        keep = np.ones(t.num_rows, bool)
        for first, last in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            edges = [v[first:last] for v in (x, y, x + w, y + h)]
            alive = keep[first:last]
            for lo in range(0, last - first, BLOCK):
                hits = over(lo, min(lo + BLOCK, last - first), *edges)
                for i in np.flatnonzero(hits.sum(axis=1) > hits[np.arange(len(hits)), lo + np.arange(len(hits))]).tolist():
                    if alive[lo + i]:
                        alive[lo + i + 1 :] &= ~hits[i, lo + i + 1 :]
        return t.filter(pa.array(keep))

    chosen = boxes.select("image_id", "box_id", "x", "y", "w", "h", "confidence")
    return over_images(chosen, [F.desc("confidence"), "box_id"], work, chosen.schema)


def fold_lines(boxes: DataFrame, joins: Callable[[int, float, float, float, float, float], bool], by_centre: bool) -> DataFrame:
    """Lines by comparing each box, by centre y, with the running means of the current line.

    ``joins`` gets the line's number of boxes and its sums of centres and heights, the box's centre and height, and the
    image's median height. Adds ``line`` (from 0) and ``ordinal`` (from 1, by centre or left x in the line). Boxes
    keep their other columns.
    """

    def work(t: pa.Table, at: np.ndarray) -> pa.Table:
        x, y, w, h, ids = (t[k].to_numpy().astype(float) for k in ("x", "y", "w", "h", "box_id"))
        cy, inside = y + h / 2, x + w / 2 if by_centre else x
        line = np.empty(len(x), np.int32)
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            middle = float(np.median(h[lo:hi]))
            n, sum_cy, sum_h, k, out = 0, 0.0, 0.0, 0, []
            for c, size in zip(cy[lo:hi].tolist(), h[lo:hi].tolist(), strict=True):
                if n == 0 or joins(n, sum_cy, sum_h, c, size, middle):
                    n, sum_cy, sum_h = n + 1, sum_cy + c, sum_h + size
                else:
                    n, sum_cy, sum_h, k = 1, c, size, k + 1
                out.append(k)
            line[lo:hi] = out
        image = np.repeat(np.arange(len(at) - 1), np.diff(at))
        by = np.lexsort((ids, inside, line, image))
        new = np.concatenate([[True], (line[by][1:] != line[by][:-1]) | (image[by][1:] != image[by][:-1])])
        first = np.flatnonzero(new)
        ordinal = np.empty(len(x), np.int32)
        ordinal[by] = np.arange(len(x)) - first[np.cumsum(new) - 1] + 1
        return t.append_column("line", pa.array(line)).append_column("ordinal", pa.array(ordinal))

    plain = boxes.drop("line", "ordinal")
    schema = StructType(plain.schema.fields + [StructField("line", IntegerType()), StructField("ordinal", IntegerType())])
    return over_images(plain, [F.col("y") + F.col("h") / 2, "box_id"], work, schema)


def group_lines(boxes: DataFrame) -> DataFrame:
    """Components to lines: within max(0.6 median height, 0.5 mean height of the line) of the line's mean centre."""
    return fold_lines(boxes, lambda n, sum_cy, sum_h, cy, h, middle: abs(cy - sum_cy / n) <= max(0.6 * middle, 0.5 * (sum_h / n)), False)


def reading_order(boxes: DataFrame, tolerance: float = 0.7, by_centre: bool = True) -> DataFrame:
    """Lines by the running mean centre, strictly within ``tolerance`` median heights; then by centre x (or left x)."""
    return fold_lines(boxes, lambda n, sum_cy, sum_h, cy, h, middle: abs(cy - sum_cy / n) < tolerance * middle, by_centre)


def merge_vertical(boxes: DataFrame, ratio: float = 0.3) -> DataFrame:
    """Boxes in order of y merged with the growing box while they overlap by more than ``ratio`` of the lower height.

    Confidence is the mean of both at each step, so it depends on the order. The x axis isn't looked at.
    """

    def work(t: pa.Table, at: np.ndarray) -> pa.Table:
        image, *columns = (t[k].to_numpy().tolist() for k in ("image_id", "x", "y", "w", "h", "confidence"))
        out: list[tuple] = []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            pos, box = 0, None
            for x, y, w, h, score in zip(*(c[lo:hi] for c in columns), strict=True):
                if box is not None:
                    bx, by, bw, bh, bs = box
                    small, shared = min(bh, h), max(0, min(by + bh, y + h) - max(by, y))
                    if small > 0 and shared / small > ratio:
                        left, top = min(bx, x), min(by, y)
                        box = (left, top, max(bx + bw, x + w) - left, max(by + bh, y + h) - top, (bs + score) / 2)
                        continue
                    out.append((image[lo], pos, *box))
                    pos += 1
                box = (x, y, w, h, score)
            out.append((image[lo], pos, *box))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int32()] * 6 + [pa.float64()], strict=True)], names=["image_id", "pos", "x", "y", "w", "h", "confidence"])

    chosen = boxes.select(F.col("image_id").cast("int").alias("image_id"), "box_id", *(F.col(k).cast("int").alias(k) for k in "xywh"), F.col("confidence").cast("double").alias("confidence"))
    return over_images(chosen, ["y", "box_id"], work, "image_id int, pos int, x int, y int, w int, h int, confidence double")


def envelopes(boxes: DataFrame, keys: list[str], pad: int | Column, width: int, height: int) -> DataFrame:
    """One padded box around each group, with its mean confidence and its number of members."""
    g = boxes.groupBy(*keys).agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"), F.avg("confidence").alias("confidence"), F.count("*").alias("n"))
    box = G.pad_clip(pad, width, height, "x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return g.select(*keys, *(v.alias(k) for k, v in box.items()), "confidence", "n")


def words(lined: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``word`` (from 0 in its line): a new one where the gap to the left neighbour exceeds the line's threshold,
    median + population deviation of gaps (under 3 gaps: half the median width), kept in 0.3 to 2 median widths."""
    w = W.partitionBy("image_id", line)
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(w.orderBy("x", "box_id"))
    b = lined.withColumn("gap", gap).withColumns({"mw": F.median("w").over(w), "n_gaps": F.count("gap").over(w), "mg": F.median("gap").over(w), "sg": F.stddev_pop("gap").over(w)})
    raw = F.when(F.col("n_gaps") >= 3, F.col("mg") + F.col("sg")).otherwise(F.lit(0.5) * F.col("mw"))
    b = b.withColumn("threshold", F.least(F.greatest(raw, F.lit(0.3) * F.col("mw")), F.lit(2.0) * F.col("mw")))
    new = F.when(F.col("gap") > F.col("threshold"), 1).otherwise(0)
    return b.withColumn("word", F.sum(new).over(w.orderBy("x", "box_id").rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("gap", "mw", "n_gaps", "mg", "sg", "threshold")


def group_blocks(lines: DataFrame, char_height: float | None = None) -> DataFrame:
    """Adds ``block`` (from 0): lines by y stay together while the gap is within max(2 median gaps, character height or
    20) and more than 0.3 of the narrower line lies over the previous one."""
    w = image().orderBy("y", "line")
    prev = {k: F.lag(k).over(w) for k in "xywh"}
    b = lines.withColumns({f"p{k}": v for k, v in prev.items()}).withColumn("gap", F.col("y") - (F.col("py") + F.col("ph")))
    limit = F.greatest(F.lit(2.0) * F.median("gap").over(image()), F.lit(20.0 if char_height is None else char_height))
    over = G.overlap_ratio(F.col("px"), F.col("pw"), F.col("x"), F.col("w"))
    b = b.withColumn("new", F.when(F.col("gap").isNull() | (F.col("gap") <= F.lit(0) + limit) & (over > 0.3), 0).otherwise(1))
    return b.withColumn("block", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("px", "py", "pw", "ph", "gap", "new")


def free_space(boxes: DataFrame) -> DataFrame:
    """Adds the least horizontal gap to boxes that share a box's rows (gap_x), and the vertical gap to those that share its
    columns (gap_y): 0 where they overlap, null where there is none."""
    far = np.int64(2**62)

    def work(t: pa.Table, at: np.ndarray) -> pa.Table:
        x, y, w, h = (t[k].to_numpy().astype(np.int64) for k in "xywh")
        out = np.full((2, t.num_rows), far)
        for first, last in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            lo, hi = np.stack([x, y])[:, first:last], np.stack([x + w, y + h])[:, first:last]
            for a in range(0, last - first, BLOCK):
                z = min(a + BLOCK, last - first)
                shared = np.minimum(hi[:, a:z, None], hi[:, None]) > np.maximum(lo[:, a:z, None], lo[:, None])
                shared[:, np.arange(z - a), np.arange(a, z)] = False
                gap = np.maximum(0, np.maximum(lo[:, None] - hi[:, a:z, None], lo[:, a:z, None] - hi[:, None]))
                out[:, first + a : first + z] = np.where(shared[::-1], gap, far).min(axis=2)
        for k, name in enumerate(("gap_x", "gap_y")):
            t = t.append_column(name, pa.array(out[k], pa.int64(), mask=out[k] == far))
        return t

    plain = boxes.drop("gap_x", "gap_y")
    return over_images(plain, ["box_id"], work, StructType([*plain.schema.fields, StructField("gap_x", LongType()), StructField("gap_y", LongType())]))


def smart_padding(boxes: DataFrame) -> DataFrame:
    """Boxes widened about their centre: 0.01 w + 0.5 h + 5 along the longer side, 0.05 h + 5 along the other, each
    limited by the free space (axis-aligned boxes)."""
    b = free_space(boxes)
    wide, tall = F.greatest("w", "h").cast("double"), F.least("w", "h").cast("double")
    inf = F.lit(1e18)
    nw = wide + F.least(wide * 0.01 + tall * 0.5 + 5, F.coalesce(F.col("gap_x").cast("double"), inf))
    nh = tall + F.least(tall * 0.05 + 5, F.coalesce(F.col("gap_y").cast("double"), inf))
    across, down = F.when(F.col("w") >= F.col("h"), nw).otherwise(nh), F.when(F.col("w") >= F.col("h"), nh).otherwise(nw)
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    return b.select("image_id", "box_id", *(v.cast("int").alias(k) for k, v in (("x1", cx - across / 2), ("y1", cy - down / 2), ("x2", cx + across / 2), ("y2", cy + down / 2))))


def members(outer: DataFrame, inner: DataFrame, centre: bool) -> DataFrame:
    """(image_id, outer_id, inner_id): inner boxes wholly in an outer one, or with their centre in it; an inner box may
    match several. Outer boxes are dealt to the bands of 64 rows they reach, inner ones to that of their centre."""
    o = outer.select("image_id", F.col("box_id").alias("outer_id"), *(F.col(k).alias(f"o{k}") for k in "xywh"), F.explode(F.sequence(F.floor(F.col("y") / 64), F.floor((F.col("y") + F.col("h")) / 64))).alias("band"))
    i = inner.select("image_id", F.col("box_id").alias("inner_id"), *(F.col(k).alias(f"i{k}") for k in "xywh")).withColumn("band", F.floor((F.col("iy") + F.col("ih") / 2) / 64))
    inside = G.point_in(G.of("o"), F.col("ix") + F.col("iw") / 2, F.col("iy") + F.col("ih") / 2) if centre else G.contains(G.of("o"), G.of("i"))
    return o.join(i, ["image_id", "band"]).where(inside).select("image_id", "outer_id", "inner_id")


def same_line(prev_cy: Column, prev_h: Column, cy: Column, h: Column) -> Column:
    return F.abs(cy - prev_cy) < F.lit(0.8) * F.greatest(h, prev_h)


def assemble(regions: DataFrame, skip_empty: bool = False) -> DataFrame:
    """Adds ``text_line`` (from 0): regions in order join the line of the one before if their centres are near.

    skip_empty leaves out regions with an error or without text, as running text does.
    """
    r = regions.where(F.col("error").isNull() & (F.length("text") > 0)) if skip_empty else regions
    w = image().orderBy("line_number")
    cy = F.col("y") + F.col("h") / 2
    new = F.when(F.lag(cy).over(w).isNull() | same_line(F.lag(cy).over(w), F.lag("h").over(w), cy, F.col("h")), 0).otherwise(1)
    return r.withColumn("new", new).withColumn("text_line", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("new")


def document_text(regions: DataFrame) -> DataFrame:
    """(image_id, text): words of a line joined by a space, lines by a line feed."""
    per_line = assemble(regions).groupBy("image_id", "text_line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "text"))), lambda s: s["text"]), " ").alias("line"))
    return per_line.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("text_line", "line"))), lambda s: s["line"]), "\n").alias("text"))


def cumulative_text(regions: DataFrame) -> DataFrame:
    """Each kept region with the document's text up to it."""
    a = assemble(regions, skip_empty=True)
    lead = F.when(F.col("line_number") == F.min("line_number").over(image()), "").when(F.lag("text_line").over(image().orderBy("line_number")) == F.col("text_line"), " ").otherwise("\n")
    upto = image().orderBy("line_number").rowsBetween(W.unboundedPreceding, 0)
    return a.withColumn("piece", F.concat(lead, F.col("text"))).withColumn("cumulative_text", F.array_join(F.collect_list("piece").over(upto), "")).drop("piece")


LEVELS = ("character", "word", "line", "block")


def detect(boxes: DataFrame, width: int, height: int, level: str = "line", min_confidence: float = 0.3) -> DataFrame:
    """Components (of one method or several, see union_candidates) to boxes of a level: filters, suppression, lines, padded
    envelopes (merged vertically for lines), words or blocks; those of at least ``min_confidence``, to nine decimals, as a
    mean's last digits depend on the order of its rows."""
    if level not in LEVELS:
        raise ValueError(f"unknown level: {level}")
    kept = suppress(filter_components(boxes, width, height))
    if level == "character":
        return kept.where(F.round("confidence", 9) >= min_confidence).select("image_id", "box_id", "x", "y", "w", "h", "confidence")
    lined = by_image(group_lines(kept)).withColumn("pad", F.greatest(F.lit(2), (F.lit(0.15) * F.median("h").over(image())).cast("int")))
    if level == "word":
        out = envelopes(words(lined), ["image_id", "line", "word", "pad"], F.col("pad"), width, height)
        return out.where(F.round("confidence", 9) >= min_confidence).select("image_id", "line", "word", *"xywh", "confidence")
    lines = envelopes(lined, ["image_id", "line", "pad"], F.col("pad"), width, height)
    merged = merge_vertical(lines.withColumnRenamed("line", "box_id"))
    if level == "block":
        out = envelopes(group_blocks(by_image(merged).withColumnRenamed("pos", "line")), ["image_id", "block"], 0, width, height)
        return out.where(F.round("confidence", 9) >= min_confidence).select("image_id", "block", *"xywh", "confidence")
    return merged.where(F.round("confidence", 9) >= min_confidence).select("image_id", "pos", *"xywh", "confidence")


def stages(boxes: DataFrame, width: int, height: int) -> dict[str, DataFrame]:
    """What line detection makes on its way, by name, to look at."""
    kept = filter_components(boxes, width, height)
    alone = suppress(kept)
    return {"components": boxes, "filtered": kept, "kept": alone, "metrics": text_metrics(alone), "grouped": group_lines(alone), "lines": detect(boxes, width, height)}


def detect_lines(boxes: DataFrame, width: int, height: int, min_confidence: float = 0.3) -> DataFrame:
    """Components to text lines (see detect), by y."""
    return in_order(detect(boxes, width, height, "line", min_confidence), "image_id", "y", "x")


def hierarchy(boxes: DataFrame, width: int, height: int, pad: int = 3) -> DataFrame:
    """(image_id, block, lines): each block's lines in order, each with its words and their boxes from left to right."""
    lined = words(group_lines(boxes))
    per_word = lined.groupBy("image_id", "line", "word").agg(F.array_sort(F.collect_list(F.struct("x", "box_id"))).alias("in_order"))
    per_line = per_word.groupBy("image_id", "line").agg(F.array_sort(F.collect_list(F.struct("word", F.transform("in_order", lambda s: s["box_id"]).alias("box_ids")))).alias("words"))
    blocks = group_blocks(envelopes(lined, ["image_id", "line"], pad, width, height)).select("image_id", "line", "block")
    return blocks.join(per_line, ["image_id", "line"]).groupBy("image_id", "block").agg(F.array_sort(F.collect_list(F.struct("line", "words"))).alias("lines"))
