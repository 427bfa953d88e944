"""Queries over boxes, contours and characters beyond the first module's, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum import fixtures as X
from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import layout, metrics
from vellum.plans.queries import BLOCKS, FILTERED, GROUPED, MERGED, SUPPRESS, WORDS, quads
from vellum.plans.registry import columns, query

WD, HT = X.WIDTH, X.HEIGHT

# candidates to boxes of each level

UNITED = "un as (select image_id, x, y, w, h, confidence::double as confidence, 'components' as source from b where box_id % 3 = 0 union all select image_id, trunc(x * (1 / 0.75::double))::int, trunc(y * (1 / 0.75::double))::int, trunc(w * (1 / 0.75::double))::int, trunc(h * (1 / 0.75::double))::int, confidence, 'stable' from b where box_id % 3 = 1 union all select image_id, trunc(x * (1 / 1.5::double))::int, trunc(y * (1 / 1.5::double))::int, trunc(w * (1 / 1.5::double))::int, trunc(h * (1 / 1.5::double))::int, confidence, 'gradient' from b where box_id % 3 = 2)"


@query("select * from un", X.BOXES, UNITED)
def united_candidates(spark, d):
    b = X.boxes(spark, d)
    return layout.union_candidates([("components", 1.0, b.where("box_id % 3 = 0")), ("stable", 0.75, b.where("box_id % 3 = 1")), ("gradient", 1.5, b.where("box_id % 3 = 2"))])


KEPT = (FILTERED, SUPPRESS.replace("from b)", "from f2)").replace("> 0.1)", "> 0.5)"), "sk as (select f2.* from f2 join (select image_id, unnest(list_transform(kept, lambda k: k.id)) as box_id from (select image_id, arg_max(kept, rn) as kept from s1 group by image_id)) using (image_id, box_id))")
LINED = GROUPED.replace("from b)", "from sk)").replace("join b on b.image_id = l2.image_id and b.box_id = l2.box_id", "join sk on sk.image_id = l2.image_id and sk.box_id = l2.box_id")
PADDED = "lp as (select *, greatest(2, trunc(0.15::double * median(h) over (partition by image_id))::int) as pad from l3)"


def padded(keys: str, rows: str, name: str, pad: str = "pad") -> str:
    return f"{name}0 as (select image_id, {keys}, {pad} as pad, min(x) as x1, min(y) as y1, max(x + w) as x2, max(y + h) as y2, avg(confidence) as confidence from {rows} group by all), {name} as (select image_id, {keys}, greatest(0, x1 - pad) as x, greatest(0, y1 - pad) as y, least({WD} - greatest(0, x1 - pad), x2 - x1 + 2 * pad) as w, least({HT} - greatest(0, y1 - pad), y2 - y1 + 2 * pad) as h, confidence from {name}0)"


MERGED_LINES = (padded("line", "lp", "pl"), MERGED.replace("order by y, box_id) as rn from b)", "order by y, line) as rn from pl)"), "ml as (select image_id, pos, arg_max(x, rn) as x, arg_max(y, rn) as y, arg_max(w, rn) as w, arg_max(h, rn) as h, arg_max(confidence, rn) as confidence from m1 group by image_id, pos)")


@query("select image_id, box_id, x, y, w, h, confidence from sk where round(confidence, 9) >= 0.3", X.BOXES, *KEPT, recursive=True)
def detected_characters(spark, d):
    return layout.detect(X.boxes(spark, d), WD, HT, "character")


@query("select image_id, line, word, x, y, w, h, confidence from pw where round(confidence, 9) >= 0.3", X.BOXES, *KEPT, LINED, PADDED, WORDS.replace("from l3)", "from lp)"), "wd as (select *, sum(case when gap > thr then 1 else 0 end) over (partition by image_id, line order by x, box_id)::int as word from w2)", padded("line, word", "wd", "pw"), recursive=True)
def detected_words(spark, d):
    return layout.detect(X.boxes(spark, d), WD, HT, "word")


@query("select * from ml where round(confidence, 9) >= 0.3", X.BOXES, *KEPT, LINED, PADDED, *MERGED_LINES, recursive=True)
def detected_lines(spark, d):
    return layout.detect_lines(X.boxes(spark, d), WD, HT)


@query("select image_id, block, x, y, w, h, confidence from pb where round(confidence, 9) >= 0.3", X.BOXES, *KEPT, LINED, PADDED, *MERGED_LINES, "mk as (select *, pos as line from ml)", BLOCKS.replace("from e1 ", "from mk "), "bk as (select *, sum(new) over (partition by image_id order by y, line)::int as block from k2)", padded("block", "bk", "pb", "0"), recursive=True)
def detected_blocks(spark, d):
    return layout.detect(X.boxes(spark, d), WD, HT, "block")


@query("select image_id, count(*) as lines, count(*) >= 2 as is_multiline from ml group by image_id", X.BOXES, *KEPT, LINED, PADDED, *MERGED_LINES, recursive=True)
def multiline_images(spark, d):
    return layout.multiline(layout.detect(X.boxes(spark, d), WD, HT, min_confidence=-1.0))


@query("select image_id, box_id, x, y, w as width, h as height, confidence::double as confidence, 'character' as level, 0 as n_children, printf('TextBox(%d, %d, %d, %d, conf=%.2f)', x, y, w, h, confidence) as described from b", X.BOXES)
def component_boxes(spark, d):
    t = layout.text_boxes(X.boxes(spark, d))
    return t.withColumn("n_children", F.size("children")).drop("children").withColumn("described", layout.described("x", "y", "width", "height"))


@query("select image_id, box_id, x, y, w as width, h as height, 1.0::double as confidence, 'line' as level from b", X.BOXES)
def wrapped_lines(spark, d):
    return layout.text_boxes(X.boxes(spark, d), "line", 1.0).drop("children")


@query("select image_id, box_id, least(1.0::double, confidence * 50 * (case when w / h > 0.2 and w / h < 5 then 1.0::double else 0.5::double end) * (case when f > 0.2 and f < 0.9 then 1.0::double else 0.5::double end) * 0.01::double) as confidence from (select *, (w * h - box_id % 3 * (w * h // 2.2::double)) / (w * h) as f from b)", X.BOXES)
def component_scores(spark, d):
    b = X.boxes(spark, d)
    area = F.col("w") * F.col("h") - F.col("box_id") % 3 * F.floor(F.col("w") * F.col("h") / F.lit(2.2))
    return b.select("image_id", "box_id", layout.component_confidence(F.col("confidence") * 50, F.col("w"), F.col("h"), area).alias("confidence"))


# score maps to boxes

CONTOURS = "cn as (select image_id, box_id as contour, box_id % 7 + 2 as points, x // 8 as x, y // 8 as y, w // 8 as w, h // 8 as h, confidence as score from b)"


def contours(spark, d):
    eighth = lambda k: F.floor(F.col(k) / 8).cast("int").alias(k)
    return X.boxes(spark, d).select("image_id", F.col("box_id").alias("contour"), (F.col("box_id") % 7 + 2).alias("points"), *map(eighth, "xywh"), F.col("confidence").alias("score"))


@query(f"select image_id, contour, {', '.join(f'trunc(least({to}::double, greatest(0.0::double, ({v}) / {size}::double * {to})))::int as {n}' for n, v, size, to in (('x1', 'x - d', WD // 8, WD), ('y1', 'y - d', HT // 8, HT), ('x2', 'x + w + d', WD // 8, WD), ('y2', 'y + h + d', HT // 8, HT)))}, score from (select *, w * h * 1.6::double / (2.0::double * (w + h)) as d from (select *, row_number() over (partition by image_id order by contour) as rk from cn) where rk <= 50 and points >= 4 and least(w, h) >= 2 and score >= 0.5) where least(w, h) + 2 * d >= 4", X.BOXES, CONTOURS)
def contour_boxes(spark, d):
    return layout.contour_boxes(contours(spark, d), WD // 8, HT // 8, WD, HT, min_size=2, first=50)


AROUND = "sqrt(6.25::double + (h-0.5::double)**2) + sqrt((w-2.5::double)**2 + 2.25::double) + sqrt(2.25::double + (h-1.5::double)**2) + sqrt((w-1.5::double)**2 + 0.25::double)"
AREA = "abs((x+w)*(y+h) - (x+w-2.5::double)*(y+0.5::double) + (x+w-2.5::double)*(y+h-1.5::double) - x*(y+h) + x*y - (x+1.5::double)*(y+h-1.5::double) + (x+1.5::double)*(y+0.5::double) - (x+w)*y) / 2"


@query(f"select image_id, box_id, x - t as x1, y - t as y1, x + w + t as x2, y + h + t as y2, area + t * around + pi() * t * t as area from (select *, area * 1.6::double / around as t from (select *, {AREA} as area, {AROUND} as around from b))", X.BOXES)
def unclipped_boxes(spark, d):
    return quads(X.boxes(spark, d)).select("image_id", "box_id", *columns(G.unclip_box(F.col("quad"))))


@query("select image_id, box_id, (x + w) * (0.4::double * 2) as first_x, (y + 0.5::double) * (0.7::double * 2) as first_y, (0.8::double * x - 0.1::double * y + 5) / (0.0001::double * x + 0.0002::double * y + 1) as warped_x, (0.2::double * x + 0.9::double * y - 3) / (0.0001::double * x + 0.0002::double * y + 1) as warped_y from b", X.BOXES)
def mapped_points(spark, d):
    q = quads(X.boxes(spark, d))
    first = F.element_at(G.net_to_image(F.col("quad"), 0.4, 0.7), 1)
    wx, wy = G.warp([0.8, -0.1, 5, 0.2, 0.9, -3, 0.0001, 0.0002, 1], F.col("x"), F.col("y"))
    return q.select("image_id", "box_id", first["x"].alias("first_x"), first["y"].alias("first_y"), wx.alias("warped_x"), wy.alias("warped_y"))


@query("select image_id, box_id, trunc(w * (32.0::double / h))::int as scaled_w, greatest(0, 128 - trunc(w * (32.0::double / h))::int) as pad, case when trunc(w * (32.0::double / h))::int < 128 then case when trunc(w * (32.0::double / h))::int > 60 then trunc(confidence * 255)::int else 255 end end as background, trunc(w * (32.0::double / h))::int > 128 as squeezed from b where trunc(w * (32.0::double / h))::int > 60 or trunc(w * (32.0::double / h))::int <= 10", X.BOXES)
def sample_plans(spark, d):
    p = X.boxes(spark, d).select("image_id", "box_id", *columns(G.plan_fit(F.col("w"), F.col("h"), F.col("confidence") * 255, width=128)))
    return p.where("scaled_w > 60 or scaled_w <= 10")


RAMP = "floor(least(1.0::double, greatest(0.0::double, 1.5::double - abs(4 * v - {at}::double))) * 255 + 0.5::double)::int"


@query(f"select p_partkey, {RAMP.format(at=1)} as blue, {RAMP.format(at=2)} as green, {RAMP.format(at=3)} as red, least(255.0::double, greatest(0.0::double, ((p_size / 10.0::double - 2.5::double) * 0.229::double + 0.485::double) * 255.0::double))::double as restored from (select *, floor(least(1.0::double, greatest(0.0::double, p_retailprice / 1800 - 0.1::double)) * 255) / 255.0::double as v from part)")
def pixel_colours(spark, d):
    p = X.table(spark, d, "part")
    heat = G.heat_colour(F.col("p_retailprice") / 1800 - 0.1)
    v = (F.col("p_size") / 10.0 - 2.5) * G.IMAGENET[1][0] + G.IMAGENET[0][0]
    return p.select("p_partkey", heat["b"].alias("blue"), heat["g"].alias("green"), heat["r"].alias("red"), F.least(F.lit(255.0), F.greatest(F.lit(0.0), v * 255.0)).alias("restored"))


@query("select p_partkey, trunc(least(255.0::double, greatest(0.0::double, ((p_size / 10.0::double - 2.5::double) * 0.224::double + 0.456::double) * 255.0::double)))::int as green from part")
def denormalised_pixels(spark, d):
    return X.table(spark, d, "part").select("p_partkey", G.denormalise_rgb(F.col("p_size") / 10.0 - 2.5, 1).alias("green"))


@query(f"select image_id, box_id, greatest(0, x - 5) as x1, greatest(0, y - 5) as y1, least({WD // 4}, x + w + 5) as x2, least({HT // 4}, y + h + 5) as y2, least({WD // 4}, x + w + 5) > greatest(0, x - 5) and least({HT // 4}, y + h + 5) > greatest(0, y - 5) as usable from b", X.BOXES)
def crop_guards(spark, d):
    b = X.boxes(spark, d).select("image_id", "box_id", *columns(G.crop(5, WD // 4, HT // 4)))
    return b.withColumn("usable", (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


# regions

@query("select image_id, row_number() over (partition by image_id order by box_id)::int as line_number, box_id as box, confidence as det_confidence from b", X.BOXES)
def zipped_detections(spark, d):
    packed = X.boxes(spark, d).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("box_id", "confidence"))).alias("s"))
    arrays = packed.select("image_id", F.transform("s", lambda v: v["box_id"]).alias("boxes"), F.transform("s", lambda v: v["confidence"]).alias("scores"))
    return layout.zip_detections(arrays)


@query("select image_id, n as line_number, text from (select *, row_number() over (partition by image_id order by y, x, line_number)::int as n from rg) where error is null and length(text) > 0", X.BOXES, X.REGIONS)
def numbered_regions(spark, d):
    r = X.regions(spark, d).withColumnRenamed("line_number", "old")
    return layout.numbered(r, ["y", "x", "old"]).select("image_id", "line_number", "text")


@query("select doc_id as image, font, levenshtein(gt, pred)::double / length(gt) as cer from pr where doc_id % 4 <> 0", X.PAIRS)
def joined_pairs(spark, d):
    p = X.pairs(spark, d).withColumnRenamed("doc_id", "image")
    found = p.where("image % 4 <> 0").select("font", "image", "pred", "time").unionByName(p.limit(1).select(F.lit("none").alias("font"), "image", "pred", "time"))
    return metrics.score_pairs(metrics.join_pairs(p.select("font", "image", "gt"), found), False).select("image", "font", "cer")


# characters and words

GLYPHS = "gl as (select distinct unnest(string_split(p_name, '')) as char from part), gw as (select char, (ascii(char) * 7 % 13 + 2)::int as width from gl where ascii(char) % 11 <> 0)"


def glyphs(spark, d):
    c = X.table(spark, d, "part").select(F.explode(T.chars(F.col("p_name"))).alias("char")).distinct()
    return c.where(F.ascii("char") % 11 != 0).select("char", (F.ascii("char") * 7 % 13 + 2).cast("int").alias("width"))


@query("select line_id, pos, char, x1, y as y1, x1 + width as x2, y + 20 as y2 from (select *, (7 + coalesce(sum(case when char = ' ' then coalesce(greatest(width, 3), 5) else coalesce(width, 0) end) over (partition by line_id order by pos rows between unbounded preceding and 1 preceding), 0))::int as x1 from (select p_partkey as line_id, (p_partkey % 100)::int as y, unnest(range(length(p_name)))::int as pos, unnest(string_split(p_name, '')) as char from part) left join gw using (char)) where char <> ' ' and width > 0", GLYPHS)
def character_boxes(spark, d):
    lines = X.table(spark, d, "part").select(F.col("p_partkey").alias("line_id"), (F.col("p_partkey") % 100).cast("int").alias("y"), F.col("p_name").alias("text"))
    return layout.character_boxes(lines, glyphs(spark, d), 7)


@query("select p_partkey, array_to_string(words[1:greatest(len(list_filter(range(1, (len(words) + 1)::bigint), lambda k: length(array_to_string(words[1:k], ' ')) * 9 <= 150)), least(2, len(words)))], ' ') as text from (select p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ') as words from part)")
def fitted_words(spark, d):
    p = X.table(spark, d, "part").select("p_partkey", F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " ").alias("words"))
    widths = F.transform(F.sequence(F.lit(1), F.size("words")), lambda k: F.length(F.array_join(F.slice("words", 1, k), " ")) * 9)
    return p.select("p_partkey", F.array_join(T.fit_words(F.col("words"), widths, 150), " ").alias("text"))
