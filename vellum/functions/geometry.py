"""Column builders over boxes: geometry, padding, overlap, resize plans, predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGENET = ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def props(x="x", y="y", w="w", h="h") -> dict[str, Column]:
    """Right and bottom edge, area, centre, text baseline, aspect ratio."""
    x, y, w, h = map(c, (x, y, w, h))
    return {"x2": x + w, "y2": y + h, "area": w * h, "cx": x + w / 2, "cy": y + h / 2, "baseline": y + F.lit(0.8) * h, "aspect": F.when(h > 0, w / h).otherwise(0.0)}


def fill(area, w="w", h="h") -> Column:
    w, h = c(w), c(h)
    return F.when(w * h > 0, c(area) / (w * h)).otherwise(0.0)


def pad_clip(pad: int, width: int, height: int, x="x", y="y", w="w", h="h") -> dict[str, Column]:
    """Grown by ``pad`` on every side; left and top are clamped, sizes cut at the image."""
    x, y, w, h = map(c, (x, y, w, h))
    nx, ny = F.greatest(F.lit(0), x - pad), F.greatest(F.lit(0), y - pad)
    return {"x": nx, "y": ny, "w": F.least(width - nx, w + 2 * pad), "h": F.least(height - ny, h + 2 * pad)}


def crop(pad: int, width: int, height: int, x="x", y="y", w="w", h="h") -> dict[str, Column]:
    """Crop window with ``pad`` around the box, inside the image; empty windows have x2 <= x1 or y2 <= y1."""
    x, y, w, h = map(c, (x, y, w, h))
    return {"x1": F.greatest(F.lit(0), x - pad), "y1": F.greatest(F.lit(0), y - pad), "x2": F.least(F.lit(width), x + w + pad), "y2": F.least(F.lit(height), y + h + pad)}


def rescale(factor: float, x="x", y="y", w="w", h="h", area=None) -> dict[str, Column]:
    out = {k: (c(v) * F.lit(factor)).cast("int") for k, v in (("x", x), ("y", y), ("w", w), ("h", h))}
    return out | ({"area": c(area) * F.lit(factor * factor)} if area is not None else {})


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two (x, y, w, h); touching boxes have none."""
    iw = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    ih = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    union = a["w"] * a["h"] + b["w"] * b["h"] - iw * ih
    return F.when((iw > 0) & (ih > 0) & (union > 0), (iw * ih).cast("double") / union).otherwise(F.lit(0.0))


def overlap_ratio(lo1: Column, size1: Column, lo2: Column, size2: Column) -> Column:
    """Overlap of two intervals over the smaller one; 0 if that is empty."""
    over = F.greatest(F.lit(0), F.least(lo1 + size1, lo2 + size2) - F.greatest(lo1, lo2))
    small = F.least(size1, size2)
    return F.when(small > 0, over.cast("double") / small).otherwise(F.lit(0.0))


def contains(outer: dict[str, Column], inner: dict[str, Column]) -> Column:
    return (outer["x"] <= inner["x"]) & (outer["y"] <= inner["y"]) & (outer["x"] + outer["w"] >= inner["x"] + inner["w"]) & (outer["y"] + outer["h"] >= inner["y"] + inner["h"])


def point_in(box: dict[str, Column], px: Column, py: Column) -> Column:
    return px.between(box["x"], box["x"] + box["w"]) & py.between(box["y"], box["y"] + box["h"])


def of(prefix: str) -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") for k in ("x", "y", "w", "h")}


def quad_box(points: Column, pad: int = 0) -> dict[str, Column]:
    """Axis-aligned box of a quad (array of structs x, y), whole numbers; sizes grow by the padding without a clamp."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x1, y1, x2, y2 = (v.cast("int") for v in (F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))
    return {"x": F.greatest(F.lit(0), x1 - pad), "y": F.greatest(F.lit(0), y1 - pad), "w": x2 - x1 + 2 * pad, "h": y2 - y1 + 2 * pad}


def quad_scale(points: Column, sx: float, sy: float, width: int, height: int) -> Column:
    """Points scaled to the original image and clipped to it, truncated."""
    cut = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(top))).cast("int")
    return F.transform(points, lambda p: F.struct(cut(p["x"] * sx, width).alias("x"), cut(p["y"] * sy, height).alias("y")))


def quad_start(points: Column) -> Column:
    """The quad begun at the corner of the smallest x + y, order kept."""
    sums = F.transform(points, lambda p: p["x"] + p["y"])
    k = F.array_position(sums, F.array_min(sums)).cast("int")
    return F.concat(F.slice(points, k, F.size(points) - k + 1), F.slice(points, 1, k - 1))


def shoelace(points: Column) -> tuple[Column, Column]:
    """Area and perimeter of a polygon."""
    nxt = F.concat(F.slice(points, 2, F.size(points) - 1), F.slice(points, 1, 1))
    cross = F.zip_with(points, nxt, lambda p, q: (p["x"] * q["y"] - q["x"] * p["y"]).cast("double"))
    side = F.zip_with(points, nxt, lambda p, q: F.sqrt(((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])).cast("double")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return F.abs(total(cross)) / 2, total(side)


def unclip_distance(points: Column, ratio: float = 1.6) -> Column:
    area, around = shoelace(points)
    return F.when(around > 0, area * ratio / around).otherwise(0.0)


def unclip_box(points: Column, ratio: float = 1.6) -> dict[str, Column]:
    """A convex polygon moved outwards by its unclip distance with rounded corners: the offset's axis-aligned edges and its
    area (area + distance * perimeter + pi * distance squared). Both are null where there is no area."""
    area, around = shoelace(points)
    d = F.when((area > 0) & (around > 0), area * ratio / around)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"x1": F.array_min(xs) - d, "y1": F.array_min(ys) - d, "x2": F.array_max(xs) + d, "y2": F.array_max(ys) + d, "area": area + d * around + F.pi() * d * d}


def net_to_image(points: Column, ratio_w: Column | float, ratio_h: Column | float, net: float = 2.0) -> Column:
    """Points of a score map of 1 / ``net`` of the size, in the image's coordinates."""
    return F.transform(points, lambda p: F.struct((p["x"] * (ratio_w * net)).alias("x"), (p["y"] * (ratio_h * net)).alias("y")))


def plan_fit(w: Column, h: Column, tail_mean: Column, height: int = 32, width: int = 512) -> dict[str, Column]:
    """A sample at the generator's height: its scaled width, the columns padded to the right, the grey they get (the mean
    of the last ten columns, 255 for widths up to 10), and whether it is squeezed instead."""
    new = (w * (F.lit(float(height)) / h)).cast("int")
    return {"scaled_w": new, "pad": F.greatest(F.lit(0), width - new), "background": F.when(new < width, F.when(new > 10, tail_mean.cast("int")).otherwise(255)), "squeezed": new > width}


def plan_cap(w: Column, h: Column, side: int = 960, step: int = 32) -> tuple[Column, Column]:
    """Long side cut to ``side``, each side to the nearest multiple of ``step`` (halves to even), at least one step."""
    scale = F.least(F.lit(1.0), F.lit(float(side)) / F.greatest(w, h))
    one = lambda v: F.greatest(F.lit(step), (F.bround((v * scale).cast("int") / F.lit(float(step))) * step).cast("int"))
    return one(w), one(h)


def plan_canvas(w: Column, h: Column, magnify: float = 1.5, canvas: int = 1280, step: int = 32) -> dict[str, Column]:
    """Magnified, cut to the canvas, padded up to multiples of ``step``; the heat map has half of that."""
    target = F.least(F.lit(float(canvas)), F.lit(magnify) * F.greatest(w, h))
    ratio = target / F.greatest(w, h)
    tw, th = (w * ratio).cast("int"), (h * ratio).cast("int")
    up = lambda v: (F.ceil(v / F.lit(float(step))) * step).cast("int")
    return {"ratio": ratio, "canvas_w": up(tw), "canvas_h": up(th), "heat_w": (up(tw) / 2).cast("int"), "heat_h": (up(th) / 2).cast("int")}


def plan_height(w: Column, h: Column, height: int = 48, width: int = 640) -> tuple[Column, Column]:
    """Width at the fixed height, and padding to the right (0 where it is cut instead)."""
    new = F.greatest(F.lit(1), F.bround(w * F.lit(float(height)) / h).cast("int"))
    return F.least(new, F.lit(width)), F.greatest(F.lit(0), width - new)


def warp(m: list[float], x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a 3 x 3 projective matrix (row by row)."""
    d = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / d, (m[3] * x + m[4] * y + m[5]) / d


def normalise_gray(v: Column) -> Column:
    return (v / 255.0 - 0.5) / 0.5


def normalise_rgb(v: Column, channel: int) -> Column:
    return (v / 255.0 - IMAGENET[0][channel]) / IMAGENET[1][channel]


def denormalise_rgb(v: Column, channel: int) -> Column:
    """normalise_rgb undone, clipped to whole bytes."""
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), (v * IMAGENET[1][channel] + IMAGENET[0][channel]) * 255.0)).cast("int")


def heat_colour(value: Column) -> Column:
    """(b, g, r) of a score from 0 to 1 on the jet colour scale: three ramps, each a quarter of the scale from the next."""
    x = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)) * 255) / 255.0
    ramp = lambda at: F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.5) - F.abs(4 * x - at))) * 255 + 0.5).cast("int")
    return F.struct(ramp(1.0).alias("b"), ramp(2.0).alias("g"), ramp(3.0).alias("r"))


def band(confidence: Column) -> Column:
    return F.when(confidence > 0.9, "high").when(confidence > 0.7, "medium").otherwise("low")


def text_like(w: Column, h: Column, area: Column, height: Column) -> Column:
    return (h > 0) & (w / h > 0.1) & (w / h < 10) & (fill(area, w, h) > 0.1) & (fill(area, w, h) < 0.95) & (h < 0.3 * height)


def gaussian(dx: Column, dy: Column, sx: Column, sy: Column) -> Column:
    return F.exp(-(dx * dx / (2 * sx * sx) + dy * dy / (2 * sy * sy)))


def corner_order(points: Column) -> Column:
    """A quad's corners from the upper left on, clockwise: the two leftmost and the two rightmost, each by y."""
    by_x = F.array_sort(F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    left, right = (F.array_sort(F.transform(F.slice(by_x, k, 2), lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x")))) for k in (1, 3))
    corner = lambda side, k: F.struct(side[k]["x"].alias("x"), side[k]["y"].alias("y"))
    return F.array(corner(left, 0), corner(right, 0), corner(right, 1), corner(left, 1))


def short_side(corners: Column) -> Column:
    side = lambda a, b: F.sqrt((corners[a]["x"] - corners[b]["x"]) ** 2 + (corners[a]["y"] - corners[b]["y"]) ** 2)
    return F.least(side(0, 1), side(0, 3))


def stable_region(w, h, solidity, min_w: int = 2, min_h: int = 6) -> tuple[Column, Column]:
    """Whether a stable region may be text, and its confidence."""
    return (c(w) >= min_w) & (c(h) >= min_h) & (c(solidity) > 0.2) & (c(solidity) < 0.95), F.lit(0.7) * c(solidity)


def gradient_region(w, h, strong, mean, std) -> tuple[Column, Column]:
    """The same for a region of strong gradients: ``strong`` pixels of magnitude over 20, their mean and deviation."""
    return (c(strong) > 10) & (c(w) / c(h) > 0.05) & (c(w) / c(h) < 15), F.lit(0.5) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - c(std) / (c(mean) + F.lit(1e-6))))


def inner_component(area, width: int, height: int, x="x", y="y", w="w", h="h") -> Column:
    """Whether a binarised component is large enough and clear of the image's border."""
    x, y, w, h = map(c, (x, y, w, h))
    return (w >= 2) & (h >= 3) & (c(area) >= 6) & (x > 0) & (y > 0) & (x + w < width) & (y + h < height)
