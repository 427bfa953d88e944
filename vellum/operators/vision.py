"""Image kernels in numpy, an image at a time in Arrow batches: binarisations, oriented boxes, outlines, augmentation.

Images are rows (image_id, width, height, channels, values): bytes row by row, blue, green, red where there are three.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.operators.raster import label

#: Block and offset of the adaptive thresholds, by name.
ADAPTIVE = {"adaptive_gauss": ("gauss", 21, 10), "adaptive_mean": ("mean", 15, 8), "sauvola": ("gauss", 51, 20), "niblack": ("mean", 11, 5)}
#: Thresholds of saturation, and of the two colour axes from both ends.
SATURATION, AXIS_HIGH, AXIS_LOW = 50, 160, 96


def grey_of(image: np.ndarray, colours: bool | None = None) -> np.ndarray:
    """Weighted sum of blue, green and red, rounded; an image of two axes is grey unless ``colours`` says."""
    return image if not (image.ndim > 2 if colours is None else colours) else np.floor(image @ np.array([0.114, 0.587, 0.299]) + 0.5).astype(np.uint8)


def equalised(grey: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation: each tile's histogram is cut at ``clip`` times its mean, what was cut off is dealt to
    all values, and a pixel's value comes from the four nearest tiles' maps, weighed by distance."""
    h, w = grey.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(grey, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th * tiles - h, tw * tiles - w) else "edge")
    limit = max(1, int(clip * th * tw / 256))
    maps = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].reshape(-1), minlength=256)
            over = int(np.maximum(n - limit, 0).sum())
            n = np.minimum(n, limit) + over // 256
            rest = over % 256
            if rest:
                n[:: max(256 // rest, 1)][:rest] += 1
            maps[i, j] = np.minimum(255, np.rint(np.cumsum(n) * 255 / (th * tw)))
    y, x = (np.arange(h) / th - 0.5), (np.arange(w) / tw - 0.5)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda i, j: maps[np.clip(i, 0, tiles - 1)[:, None], np.clip(j, 0, tiles - 1)[None, :], grey]
    out = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    return np.rint(out).astype(np.uint8)


#: Pixels of a tile up to which images are equalised together, and pixels of images worked on together.
SMALL, TOGETHER = 16, 1 << 16


def equalised_all(grey: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """equalised for images of one size. Tiles of few pixels have no histogram: a map's value is counted from the pixels, of
    equal ones no more than the limit, what was cut off being dealt in steps."""
    h, w = grey.shape[1:]
    th, tw = -(-h // tiles), -(-w // tiles)
    size = th * tw
    if size > SMALL:
        return np.stack([equalised(g, clip, tiles) for g in grey])
    padded = np.pad(grey, ((0, 0), (0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th * tiles - h, tw * tiles - w) else "edge")
    v = padded.reshape(-1, tiles, th, tiles, tw).transpose(0, 1, 3, 2, 4).reshape(-1, tiles, tiles, size)
    nth = np.stack([(v[..., :k] == v[..., k : k + 1]).sum(axis=-1) for k in range(size)], axis=-1)
    counted = nth < max(1, int(clip * size / 256))
    over = size - counted.sum(axis=-1)
    rest, step = over % 256, np.maximum(256 // np.maximum(over % 256, 1), 1)
    level = grey.astype(int)

    def at(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        tile = (slice(None), np.clip(i, 0, tiles - 1)[:, None], np.clip(j, 0, tiles - 1)[None, :])
        upto = ((v[tile] <= grey[..., None]) & counted[tile]).sum(axis=-1) + over[tile] // 256 * (level + 1) + np.minimum(rest[tile], level // step[tile] + 1)
        return np.minimum(255, np.rint(upto * 255 / size))

    y, x = (np.arange(h) / th - 0.5), (np.arange(w) / tw - 0.5)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    out = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    return np.rint(out).astype(np.uint8)


def otsu_all(v: np.ndarray) -> np.ndarray:
    """otsu for each image, to be held against its pixels."""
    n = np.bincount((v.reshape(len(v), -1) + 256 * np.arange(len(v))[:, None]).reshape(-1), minlength=256 * len(v)).reshape(-1, 256).astype(float)
    low, s = np.cumsum(n, axis=1), np.cumsum(n * np.arange(256), axis=1)
    high = low[:, -1:] - low
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((low > 0) & (high > 0), low * high * (s / low - (s[:, -1:] - s) / high) ** 2, 0)
    return np.argmax(between, axis=1)[:, None, None]


def otsu(v: np.ndarray) -> int:
    """The first value that parts the histogram with the largest between-class variance."""
    n = np.bincount(v.reshape(-1), minlength=256).astype(float)
    low, total = np.cumsum(n), n.sum()
    s, whole = np.cumsum(n * np.arange(256)), (n * np.arange(256)).sum()
    high = total - low
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((low > 0) & (high > 0), low * high * (s / low - (whole - s) / high) ** 2, 0)
    return int(np.argmax(between))


def weighed(v: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The same kernel along the last two axes, border pixels repeated beyond the border."""
    r, out = len(kernel) // 2, v.astype(float)
    for axis in (v.ndim - 2, v.ndim - 1):
        p = np.pad(out, [(r, r) if a == axis else (0, 0) for a in range(v.ndim)], mode="edge")
        out = sum(k * np.take(p, np.arange(i, i + v.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    return out


def gaussian(block: int, sigma: float | None = None) -> np.ndarray:
    s = sigma or 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(block) - block // 2) ** 2) / (2 * s * s))
    return k / k.sum()


def adaptive(v: np.ndarray, kind: str, block: int, offset: int) -> np.ndarray:
    mean = weighed(v, gaussian(block) if kind == "gauss" else np.full(block, 1 / block))
    return v > np.rint(np.round(mean, 9)) - offset


def lab(image: np.ndarray) -> np.ndarray:
    """Lightness and two colour axes of sRGB (D65), each from 0 to 255, the axes' middle at 128."""
    c = image[..., ::-1] / 255.0
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    xyz = linear @ np.array([[0.412453, 0.212671, 0.019334], [0.357580, 0.715160, 0.119193], [0.180423, 0.072169, 0.950227]]) / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    lightness = np.where(xyz[..., 1] > 0.008856, 116 * f[..., 1] - 16, 903.3 * xyz[..., 1])
    out = np.stack([lightness * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=-1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def gradient(v: np.ndarray) -> np.ndarray:
    """Largest less smallest of a pixel and its four neighbours."""
    p = np.pad(v, [(0, 0)] * (v.ndim - 2) + [(1, 1)] * 2, mode="edge").astype(int)
    near = np.stack([p[..., 1:-1, 1:-1], p[..., :-2, 1:-1], p[..., 2:, 1:-1], p[..., 1:-1, :-2], p[..., 1:-1, 2:]])
    return (near.max(axis=0) - near.min(axis=0)).astype(np.uint8)


def candidates(image: np.ndarray, colours: bool = True) -> dict[str, np.ndarray]:
    """Named masks of an image: 26 with colours, 11 of a grey one."""
    return {name: mask[0] for name, mask in candidates_all(image[None], image.ndim == 3, colours).items()}


def candidates_all(image: np.ndarray, coloured: bool, colours: bool = True) -> dict[str, np.ndarray]:
    """candidates for images of one size, along the first axis."""
    out: dict[str, np.ndarray] = {}

    def both(name: str, mask: np.ndarray) -> None:
        out[name], out[f"{name}_inv"] = mask, ~mask

    even = equalised_all(grey_of(image, coloured))
    both("otsu", even > otsu_all(even))
    for name, rule in ADAPTIVE.items():
        both(name, adaptive(even, *rule))
    if colours and coloured:
        value = image.max(axis=3)
        l, *axes = np.moveaxis(lab(image), 3, 0)
        for name, channel in [("blue", image[..., 0]), ("green", image[..., 1]), ("red", image[..., 2]), ("hsv_v", value), ("lab_l", l)]:
            flat = equalised_all(channel)
            both(f"{name}_otsu", flat > otsu_all(flat))
            if name == "hsv_v":
                spread = (value.astype(int) - image.min(axis=3)) * 255 / np.maximum(value, 1)
                out["hsv_s"] = np.floor(spread + 0.5) > SATURATION
        for name, axis in zip("ab", axes, strict=True):
            out[f"lab_{name}_high"], out[f"lab_{name}_low"] = axis > AXIS_HIGH, axis <= AXIS_LOW
    edges = gradient(even)
    out["morph_gradient"] = edges > otsu_all(edges)
    return out


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise in the plane, without points on its edges."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(seq: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def least_rectangle(points: np.ndarray) -> np.ndarray:
    """Corners of the rectangle of least area round the points: one of its sides lies on a side of their hull."""
    h = hull(np.asarray(points, float))
    if len(h) == 1:
        return np.repeat(h, 4, axis=0)
    best: tuple[float, np.ndarray] | None = None
    for a, b in zip(h, np.roll(h, -1, axis=0), strict=True):
        u = (b - a) / np.linalg.norm(b - a)
        v = np.array([-u[1], u[0]])
        s, t = h @ u, h @ v
        area = np.ptp(s) * np.ptp(t)
        if best is None or area < best[0] - 1e-9:
            best = area, np.array([x * u + y * v for x, y in ((s.min(), t.min()), (s.max(), t.min()), (s.max(), t.max()), (s.min(), t.max()))])
    return best[1]


def from_upper_left(quad: np.ndarray) -> np.ndarray:
    """The corners clockwise on the screen, from the smallest x + y on."""
    area = (quad[:, 0] * np.roll(quad[:, 1], -1) - np.roll(quad[:, 0], -1) * quad[:, 1]).sum()
    quad = quad if area >= 0 else quad[::-1]
    return np.roll(quad, -int(quad.sum(axis=1).argmin()), axis=0)


def widened(mask: np.ndarray, size: int) -> np.ndarray:
    """A mask dilated by a square of ``size``, whose anchor is its middle."""
    out, before = np.zeros_like(mask), size // 2
    ys, xs = np.nonzero(mask)
    for dy in range(-(size - 1 - before), before + 1):
        for dx in range(-(size - 1 - before), before + 1):
            y, x = ys + dy, xs + dx
            ok = (y >= 0) & (x >= 0) & (y < mask.shape[0]) & (x < mask.shape[1])
            out[y[ok], x[ok]] = True
    return out


def linked_quads(text: np.ndarray, link: np.ndarray, least_text: float = 0.7, least_link: float = 0.4, low: float = 0.4, least_area: int = 10) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(component, quad, its mask) of a text map's and a link map's joint components that are large and sure enough. Pixels of
    the link alone join, but don't widen; a quad that is nearly square is set upright."""
    on, joins = text > low, link > least_link
    parts = label(on | joins, eight=False)
    out = []
    for n in range(1, int(parts.max(initial=0)) + 1):
        mine = parts == n
        ys, xs = np.nonzero(mine)
        if len(ys) < least_area or text[mine].max() < least_text:
            continue
        w, h = int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1
        more = int(np.sqrt(len(ys) * min(w, h) / (w * h)) * 2)
        window = np.zeros_like(mine)
        window[max(0, ys.min() - more) : ys.max() + more + 2, max(0, xs.min() - more) : xs.max() + more + 2] = True
        ys, xs = np.nonzero(widened(mine & ~(joins & ~on), 1 + more) & window)
        if not len(ys):
            continue
        quad = least_rectangle(np.stack([xs, ys], axis=1))
        a, b = np.linalg.norm(quad[0] - quad[1]), np.linalg.norm(quad[1] - quad[2])
        if abs(1 - max(a, b) / (min(a, b) + 1e-5)) <= 0.1:
            quad = np.array([[xs.min(), ys.min()], [xs.max(), ys.min()], [xs.max(), ys.max()], [xs.min(), ys.max()]], float)
        out.append((n, from_upper_left(quad), mine))
    return out


def curved_outline(mask: np.ndarray, quad: np.ndarray, points: int = 5, tall: float = 0.7, reach: float = 1.45) -> np.ndarray | None:
    """The curved outline of a word under its quad: 2 * ``points`` + 4 points, along the top from the left and back along the
    bottom; None where the word isn't curved (nearly as tall as the quad), too small or too short for it.

    The quad's own axes are the coordinates. Pivots are the tallest columns of every second part of the width; each is
    widened across the line through its neighbouring parts' centres by half the pivots' median height; at both ends
    the outline goes on until it leaves the word.
    """
    across, down = quad[1] - quad[0], quad[2] - quad[1]
    w, h = int(np.linalg.norm(across) + 1), int(np.linalg.norm(down) + 1)
    if min(w, h) < 10:
        return None
    to_image = lambda x, y: quad[0] + np.multiply.outer(np.asarray(x) / w, across) + np.multiply.outer(np.asarray(y) / h, down)
    gx, gy = np.meshgrid(np.arange(w), np.arange(h))
    at = np.rint(to_image(gx.reshape(-1), gy.reshape(-1))).astype(int)
    inside = (at >= 0).all(axis=1) & (at[:, 0] < mask.shape[1]) & (at[:, 1] < mask.shape[0])
    word = np.zeros(w * h, bool)
    word[inside] = mask[at[inside, 1], at[inside, 0]]
    word = word.reshape(h, w)
    xs = np.flatnonzero(word.sum(axis=0) >= 2)
    if not len(xs):
        return None
    top, bottom = word[:, xs].argmax(axis=0), h - 1 - word[::-1, xs].argmax(axis=0)
    heights, mid = bottom - top + 1, (top + bottom) / 2
    parts = 2 * points + 1
    part = np.minimum(parts - 1, (xs / (w / parts)).astype(int))
    if h * tall < heights.max() or len(np.unique(part)) < parts:
        return None
    centres = np.array([(xs[part == k].mean(), mid[part == k].mean()) for k in range(parts)])
    pivots = [np.flatnonzero(part == k)[heights[part == k].argmax()] for k in range(1, parts, 2)]
    if w / parts < heights[pivots].max() * 0.25:
        return None
    half = np.median(heights[pivots]) * reach / 2
    slope = centres[2::2] - centres[:-2:2]
    angle = -np.arctan2(slope[:, 1], slope[:, 0])
    p = np.stack([xs[pivots], mid[pivots]], axis=1)
    off = half * np.stack([np.sin(angle), np.cos(angle)], axis=1)
    upper, lower = p - off, p + off

    def end(k: int, others: tuple[int, int], sign: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = others
        grade = (p[a, 1] - p[k, 1]) / (p[a, 0] - p[k, 0]) + (p[b, 1] - p[a, 1]) / (p[b, 0] - p[a, 0])
        steps = np.arange(0.5, 2.0, 0.2)
        for n, r in enumerate(steps):
            move = sign * 2 * half * r * np.array([1.0, grade])
            u, v = upper[k] + move, lower[k] + move
            line = np.rint(np.linspace(u, v, 2 * h)).astype(int)
            ok = (line >= 0).all(axis=1) & (line[:, 0] < w) & (line[:, 1] < h)
            if n + 2 >= len(steps) or not word[line[ok, 1], line[ok, 0]].any():
                break
        return u, v

    first, last = end(0, (1, 2), -1), end(points - 1, (points - 2, points - 3), 1)
    outline = np.array([first[0], *upper, last[0], last[1], *lower[::-1], first[1]])
    return to_image(outline[:, 0], outline[:, 1])


def augmented(grey: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Noise, blur, thinning or thickening, contrast and brightness, each in some of the cases."""
    v = grey
    if rng.random() < 0.4:
        v = np.clip(v + rng.standard_normal(v.shape) * rng.uniform(3, 8), 0, 255).astype(np.uint8)
    if rng.random() < 0.3:
        v = np.clip(np.rint(weighed(v, gaussian(int(rng.choice([3, 5]))))), 0, 255).astype(np.uint8)
    if rng.random() < 0.2:
        p = np.pad(v, ((1, 0), (1, 0)), mode="edge")
        four = np.stack([p[1:, 1:], p[:-1, 1:], p[1:, :-1], p[:-1, :-1]])
        v = four.min(axis=0) if rng.random() < 0.5 else four.max(axis=0)
    if rng.random() < 0.3:
        v = np.clip(np.rint(v * rng.uniform(0.85, 1.15) + rng.integers(-15, 16)), 0, 255).astype(np.uint8)
    return v


def unpacked(batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    for image, w, h, n, values in zip(batch["image_id"], batch["width"], batch["height"], batch["channels"], batch["values"], strict=True):
        v = np.asarray(values)
        yield image, v.reshape(h, w) if n == 1 else v.reshape(h, w, n)


def binarise(images: DataFrame, colours: bool = True) -> DataFrame:
    """(image_id, candidate, on, values): each candidate mask of each image and its number of set pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.stack([b[k].to_numpy() for k in ("height", "width", "channels")], axis=1).reshape(-1, 3)
            for h, w, n in np.unique(sizes, axis=0).tolist():
                rows = np.flatnonzero((sizes == (h, w, n)).all(axis=1))
                step = max(1, TOGETHER // max(1, h * w))
                for lo in range(0, len(rows), step):
                    t = b.take(pa.array(rows[lo : lo + step]))
                    v = t["values"].flatten().to_numpy().reshape((t.num_rows, h, w) if n == 1 else (t.num_rows, h, w, n)).astype(np.uint8)
                    masks = candidates_all(v, n > 1, colours)
                    on = np.stack(list(masks.values()), axis=1).reshape(t.num_rows * len(masks), h * w)
                    ids = t["image_id"].take(pa.array(np.repeat(np.arange(t.num_rows), len(masks))))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(on) + 1) * (h * w), pa.int32()), pa.array(on.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([ids.cast(pa.int32()), pa.array(list(masks) * t.num_rows), pa.array(on.sum(axis=1), pa.int32()), lists], names=["image_id", "candidate", "on", "values"])

    return images.select("image_id", "width", "height", "channels", "values").mapInArrow(run, "image_id int, candidate string, on int, values array<boolean>")


def linked_boxes(images: DataFrame, least_text: float = 0.7, least_link: float = 0.4, low: float = 0.4, least_area: int = 10) -> DataFrame:
    """(image_id, component, points): quads of two score maps (image_id, width, height, text, link)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for image, w, h, text, link in zip(b["image_id"], b["width"], b["height"], b["text"], b["link"], strict=True):
                maps = (np.asarray(m, float).reshape(h, w) for m in (text, link))
                got += [(image, n, [{"x": float(x), "y": float(y)} for x, y in q]) for n, q, _ in linked_quads(*maps, least_text, least_link, low, least_area)]
            yield pd.DataFrame(got, columns=["image_id", "component", "points"])

    return images.select("image_id", "width", "height", "text", "link").mapInPandas(run, "image_id int, component int, points array<struct<x:double,y:double>>")


def augment(images: DataFrame, seed: int) -> DataFrame:
    """The same grey images, changed at random; an image's number and the seed say how."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(values=[augmented(v.astype(np.uint8), np.random.default_rng([seed, image])).reshape(-1).astype(np.int32) for image, v in unpacked(b)])

    return images.select("image_id", "width", "height", "channels", "values").mapInPandas(run, "image_id int, width int, height int, channels int, values array<int>")
