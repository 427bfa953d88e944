"""Queries over pixels and score maps beyond the first module's, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum import fixtures as X
from vellum.operators import raster, vision
from vellum.plans.queries import CHARS, HT, MAP, WD, characters, images
from vellum.plans.registry import query

#: Grey images of 8 x 8 pixels, one a vector.
GREY = "gy as (select image_id, i // 8 as py, i % 8 as px, least(255, greatest(0, floor((e + 0.6::double) * 200)))::int as v from (select vec_id::int as image_id, unnest(range(64))::int as i, unnest(embedding::double[]) as e from embeddings))"


def grey_images(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("image_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "e"))
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("e") + 0.6) * 200))).cast("int")
    return e.select("image_id", F.floor(F.col("i") / 8).cast("int").alias("py"), (F.col("i") % 8).alias("px"), v.alias("v"))


#: Colours, 16 pixels of three values a vector.
COLOURS = "co as (select image_id, p, least(255, greatest(0, floor((e[3 * p + 1] + 0.6::double) * 200)))::int as b, least(255, greatest(0, floor((e[3 * p + 2] + 0.6::double) * 200)))::int as g, least(255, greatest(0, floor((e[3 * p + 3] + 0.6::double) * 200)))::int as r from (select vec_id::int as image_id, unnest(range(16))::int as p, embedding::double[] as e from embeddings))"


@query("select image_id, p, round(0.114::double * b + 0.587::double * g + 0.299::double * r)::int as grey, greatest(b, g, r) as value, case when greatest(b, g, r) > 0 then round((greatest(b, g, r) - least(b, g, r)) * 255 / greatest(b, g, r)::double)::int else 0 end as saturation from co", COLOURS)
def colour_channels(spark, d):
    e = X.table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p"), F.col("embedding").cast("array<double>").alias("e"))
    one = lambda k: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("e")[3 * F.col("p") + k] + 0.6) * 200))).cast("int")
    c = e.select("image_id", "p", one(0).alias("b"), one(1).alias("g"), one(2).alias("r"))
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    value, saturation = raster.saturation(b, g, r)
    return c.select("image_id", "p", raster.grey(b, g, r).alias("grey"), value.alias("value"), saturation.alias("saturation"))


def near(radius: int, clamp: str = "least(7, greatest(0, {c} + {o}))") -> str:
    """Each pixel with the values around it, those beyond the border taken from where ``clamp`` says."""
    return f"nb as (select a.image_id, a.px, a.py, a.v, dx, dy, c.v as w from gy a, (select unnest(range(-{radius}, {radius + 1})) as dx), (select unnest(range(-{radius}, {radius + 1})) as dy), gy c where c.image_id = a.image_id and c.px = {clamp.format(c='a.px', o='dx')} and c.py = {clamp.format(c='a.py', o='dy')})"


@query("select image_id, px, py, any_value(v) > round_even(sum(w) / 121.0::double, 0)::int - 5 as on_ from nb group by all", GREY, near(5))
def mean_thresholds(spark, d):
    return raster.mean_threshold(grey_images(spark, d), 11, 5).select("image_id", "px", "py", F.col("on").alias("on_"))


MIRROR = "case when {c} + {o} < 0 then 1 when {c} + {o} > 7 then 6 else {c} + {o} end"


@query("select image_id, px, py, gx, gy, floor(sqrt((gx * gx + gy * gy)::double) / max(sqrt((gx * gx + gy * gy)::double)) over (partition by image_id) * 255)::int as magnitude from (select image_id, px, py, sum(w * dx * (2 - abs(dy)))::bigint as gx, sum(w * dy * (2 - abs(dx)))::bigint as gy from nb group by all)", GREY, near(1, MIRROR))
def sobel_gradients(spark, d):
    return raster.sobel(grey_images(spark, d)).drop("v")


@query("select a.image_id, a.px, a.py, max(c.v) - min(c.v) as edge from gy a join gy c on c.image_id = a.image_id and abs(c.px - a.px) + abs(c.py - a.py) <= 1 group by a.image_id, a.px, a.py", GREY)
def morphological_gradients(spark, d):
    return raster.morphological_gradient(grey_images(spark, d)).drop("v")


QUADS = "qd as (select image_id, box_id, x as x0, y as y0, x + w as x1, y + (h // 3) as y1, x + w as x2, y + h + 1 as y2, x - 1 as x3, y + h as y3 from ch)"
INSIDE = " and ".join(f"(x{(k + 1) % 4} - x{k}) * (py - y{k}) - (y{(k + 1) % 4} - y{k}) * (px - x{k}) >= 0" for k in range(4))


@query(f"select qd.image_id, qd.box_id, round(coalesce(avg(value), 0), 6) as score from qd left join mp on mp.image_id = qd.image_id and {INSIDE} group by all", X.BOXES, CHARS, MAP, QUADS)
def quad_scores(spark, d):
    c = characters(spark, d)
    x, y, w, h = (F.col(k) for k in "xywh")
    p = lambda a, b: F.struct(a.cast("int").alias("x"), b.cast("int").alias("y"))
    q = c.withColumn("points", F.array(p(x, y), p(x + w, y + F.floor(h / 3)), p(x + w, y + h + 1), p(x - 1, y + h)))
    return raster.quad_map_scores(q, WD, HT).withColumn("score", F.round("score", 6))


EXTENTS = "ex as (select image_id, px, min(py) as top, max(py) as bottom from mp where value > 0.6 group by all having count(*) >= 2)"


@query("select image_id, px, top, bottom from ex", X.BOXES, CHARS, MAP, EXTENTS)
def column_extents(spark, d):
    return raster.map_columns(characters(spark, d), WD, HT, 0.6)


@query("select *, median(height) over (partition by image_id) as median_height from (select image_id, seg as segment, round(avg(px), 9) as cx, round(avg(mid), 9) as cy, case when seg % 2 = 1 then arg_max(px, (h, -px)) end as pivot_x, case when seg % 2 = 1 then arg_max(mid, (h, -px)) end as pivot_y, case when seg % 2 = 1 then max(h) end as height from (select *, (top + bottom) * 0.5::double as mid, bottom - top + 1 as h, least(10, floor(px / (160 / 11.0::double)))::int as seg from ex) group by image_id, seg)", X.BOXES, CHARS, MAP, EXTENTS)
def outline_segments(spark, d):
    s = raster.segments(raster.map_columns(characters(spark, d), WD, HT, 0.6), WD // 8)
    return s.withColumns({"cx": F.round("cx", 9), "cy": F.round("cy", 9)})


# labelled components by transitive closure


def labelled(mask: str, eight: bool) -> tuple[str, ...]:
    """fg: an image's pixels in the mask; co: (image_id, i, component), numbered by each component's first pixel."""
    step = "abs(a.px - c.px) <= 1 and abs(a.py - c.py) <= 1" if eight else "abs(a.px - c.px) + abs(a.py - c.py) = 1"
    return (
        f"fg as (select * from (select vec_id::int as image_id, unnest(range(64))::int as i, unnest(range(64))::int % 8 as px, unnest(range(64))::int // 8 as py, unnest(embedding::double[]) as v from embeddings) where {mask})",
        f"ed as (select a.image_id, a.i as a, c.i as c from fg a join fg c on a.image_id = c.image_id and {step})",
        "cl as (select image_id, i as a, i as c from fg union select cl.image_id, cl.a, ed.c from cl join ed on ed.image_id = cl.image_id and ed.a = cl.c)",
        "lo as (select image_id, a as i, min(c) as root from cl group by all)",
        "cc as (select lo.image_id, lo.i, dense_rank() over (partition by lo.image_id order by root)::int as component, px, py, v from lo join fg using (image_id, i))",
        "st as (select image_id, component, min(px) as x, min(py) as y, max(px) - min(px) + 1 as w, max(py) - min(py) + 1 as h, count(*)::int as area, avg(px) as cx, avg(py) as cy, max(v) as top from cc group by all)",
    )


@query("select * from st", *labelled("v > 0.05", True), recursive=True)
def pixel_components(spark, d):
    return raster.components(images(spark, d), 0.05)


@query("select image_id, component, greatest(0, x - g) as x, greatest(0, y - g) as y, w + 2 * g as w, h + 2 * g as h, area, top from (select *, floor(sqrt(area * least(w, h) / (w * h)) * 2)::int as g from st) where area >= 4 and top >= 0.1", *labelled("v > 0.02", False), recursive=True)
def score_map_boxes(spark, d):
    return raster.score_map_boxes(images(spark, d), 0.02, 0.1, 4)


# image kernels


def byte_images(spark: SparkSession, d: str, channels: int) -> DataFrame:
    e = X.table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("image_id"), F.slice(F.col("embedding").cast("array<double>"), 1, 64 if channels == 1 else 48).alias("e"))
    values = F.transform("e", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v + 0.6) * 200))).cast("int"))
    side = 8 if channels == 1 else 4
    return e.select("image_id", F.lit(side).alias("width"), F.lit(side).alias("height"), F.lit(channels).alias("channels"), values.alias("values"))


@query()
def binarised_images(spark, d):
    return vision.binarise(byte_images(spark, d, 3)).select("image_id", "candidate", "on")


@query()
def augmented_images(spark, d):
    return vision.augment(byte_images(spark, d, 1), 3).select("image_id", F.array_join(F.col("values").cast("array<string>"), " ").alias("values"))


@query()
def linked_boxes(spark, d):
    maps = images(spark, d).select("image_id", "width", "height", F.col("values").alias("text"), F.reverse("values").alias("link"))
    return vision.linked_boxes(maps, 0.1, 0.15, 0.05, 4)


UNDER = f"us as (select st.image_id, st.component as contour, any_value(x) as x, any_value(y) as y, any_value(w) as w, any_value(h) as h, round(avg(e.v), 9) as score from st join (select vec_id::int as image_id, unnest(range(64))::int % 8 as px, unnest(range(64))::int // 8 as py, unnest(embedding::double[]) as v from embeddings) e on e.image_id = st.image_id and e.px >= x and e.px < x + w and e.py >= y and e.py < y + h group by st.image_id, st.component)"
TO = ", ".join(f"trunc(least(64.0::double, greatest(0.0::double, ({v}) / 8.0::double * 64)))::int as {n}" for n, v in (("x1", "x - d"), ("y1", "y - d"), ("x2", "x + w + d"), ("y2", "y + h + d")))


@query(f"select image_id, contour, {TO}, score from (select *, w * h * 1.6::double / (2.0::double * (w + h)) as d from us where w > 1 and h > 1 and score >= 0.02 and least(w, h) >= 2) where least(w, h) + 2 * d >= 4", *labelled("v > 0.05", True), UNDER, recursive=True)
def score_boxes(spark, d):
    i = images(spark, d)
    return raster.score_boxes(i, 8, 8, 64, 64, low=0.05, threshold=0.02, min_size=2)
