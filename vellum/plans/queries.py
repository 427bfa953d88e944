"""The engine's own queries and their DuckDB SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum import fixtures as X
from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import beam, corpus, decode, layout, metrics, raster
from vellum.plans import models
from vellum.plans.registry import QUERIES, SQL, columns, query  # noqa: F401
from vellum.sources import readers, writers
from vellum.streaming import running

WD, HT = X.WIDTH, X.HEIGHT


# quality


@query("select font, count(*) as images, avg(cer) as cer, avg(exact::double) as accuracy, avg(time) as mean_time, greatest(0.0::double, 1 - avg(cer)) as char_accuracy, 1 / avg(time) as fps from (select *, levenshtein(gt, pred)::double / length(gt) as cer, (gt = pred)::int as exact from (select font, time, regexp_replace(gt, '^\\s+|\\s+$', '', 'g') as gt, regexp_replace(pred, '^\\s+|\\s+$', '', 'g') as pred from pr)) group by font", X.PAIRS)
def quality_by_font(spark, d):
    return metrics.by_font(metrics.score_pairs(X.pairs(spark, d)))


FONTS = "fs as (select font, count(*) as images, avg(levenshtein(gt, pred)::double / length(gt)) as cer, 1 / avg(time) as fps from pr group by font)"


@query("select count(*) as fonts, sum(images)::bigint as images, avg(cer) as cer, avg(fps) as fps, 1000 / avg(fps) as ms from fs", X.PAIRS, FONTS)
def quality_overall(spark, d):
    return metrics.overall(metrics.by_font(metrics.score_pairs(X.pairs(spark, d), False)))


@query("select font, doc_id, rank from (select font, doc_id, row_number() over (partition by font order by doc_id)::int as rank from pr where gt <> pred) where rank <= 3", X.PAIRS)
def first_mismatches(spark, d):
    return metrics.first_mismatches(metrics.score_pairs(X.pairs(spark, d), False)).select("font", "doc_id", "rank")


@query("select font, row_number() over (order by cer desc, font)::int as rank from fs", X.PAIRS, FONTS)
def font_ranking(spark, d):
    f = metrics.by_font(metrics.score_pairs(X.pairs(spark, d), False))
    return f.select("font", F.row_number().over(W.orderBy("char_accuracy", "font")).alias("rank"))


@query("select image_id, count(*) as total, avg(confidence) * 100 as mean_pct, count(*) filter (confidence > 0.9) as high, count(*) filter (confidence > 0.7 and confidence <= 0.9) as medium, count(*) filter (confidence <= 0.7) as low from rg group by image_id", X.BOXES, X.REGIONS)
def report_stats(spark, d):
    return metrics.report_stats(X.regions(spark, d))


@query("select user_id as epoch, avg(value) as loss, 100.0::double * sum(r) / sum(s) as accuracy, 100.0::double * sum(r) filter (event_id % 10 = 0) / sum(s) filter (event_id % 10 = 0) as sampled_accuracy from (select *, event_id % 3 as r, 4 as s from events) group by user_id")
def training_stats(spark, d):
    e = X.table(spark, d, "events")
    return metrics.training_stats(e.select(F.col("user_id").alias("epoch"), F.col("event_id").alias("batch"), F.col("value").alias("loss"), (F.col("event_id") % 3).alias("right"), F.lit(4).alias("seen")))


# geometry


@query("select image_id, box_id, x + w as x2, y + h as y2, w * h as area, x + w / 2 as cx, y + h / 2 as cy, y + 0.8::double * h as baseline, w / h as aspect from b", X.BOXES)
def box_props(spark, d):
    return X.boxes(spark, d).select("image_id", "box_id", *columns(G.props()))


@query(f"select image_id, box_id, greatest(0, x - 7) as x, greatest(0, y - 7) as y, least({WD} - greatest(0, x - 7), w + 14) as w, least({HT} - greatest(0, y - 7), h + 14) as h, greatest(0, x - 5) as c_x1, greatest(0, y - 5) as c_y1, least({WD}, x + w + 5) as c_x2, least({HT}, y + h + 5) as c_y2, trunc(x * 0.75::double)::int as s_x, trunc(y * 0.75::double)::int as s_y, trunc(w * 0.75::double)::int as s_w, trunc(h * 0.75::double)::int as s_h from b", X.BOXES)
def box_padding(spark, d):
    return X.boxes(spark, d).select("image_id", "box_id", *columns(G.pad_clip(7, WD, HT)), *columns(G.crop(5, WD, HT), "c_"), *columns(G.rescale(0.75), "s_"))


def quads(boxes: DataFrame) -> DataFrame:
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y, w, h = (F.col(k) for k in "xywh")
    return boxes.withColumn("quad", F.array(p(x + w, y + F.lit(0.5)), p(x + w - F.lit(2.5), y + h), p(x, y + h - F.lit(1.5)), p(x + F.lit(1.5), y)))


@query(f"select image_id, box_id, greatest(0, x - 3) as x, greatest(0, y - 3) as y, w + 6 as w, h + 6 as h, (x + 1.5::double)::double as start_x, y::double as start_y, area, 1.6::double * area / around as distance, trunc(least(greatest((x + w) * 1.25::double, 0), {WD}))::int as scaled_x from (select *, abs((x+w)*(y+h) - (x+w-2.5::double)*(y+0.5::double) + (x+w-2.5::double)*(y+h-1.5::double) - x*(y+h) + x*y - (x+1.5::double)*(y+h-1.5::double) + (x+1.5::double)*(y+0.5::double) - (x+w)*y) / 2 as area, sqrt(6.25::double + (h-0.5::double)**2) + sqrt((w-2.5::double)**2 + 2.25::double) + sqrt(2.25::double + (h-1.5::double)**2) + sqrt((w-1.5::double)**2 + 0.25::double) as around from b)", X.BOXES)
def quad_boxes(spark, d):
    q = quads(X.boxes(spark, d))
    area, _ = G.shoelace(F.col("quad"))
    first = F.element_at(G.quad_start(F.col("quad")), 1)
    return q.select("image_id", "box_id", *columns(G.quad_box(F.col("quad"), 3)), first["x"].alias("start_x"), first["y"].alias("start_y"), area.alias("area"), G.unclip_distance(F.col("quad")).alias("distance"), F.element_at(G.quad_scale(F.col("quad"), 1.25, 1.25, WD, HT), 1)["x"].alias("scaled_x"))


NEXT = "nx as (select *, lead(x) over o as qx, lead(y) over o as qy, lead(w) over o as qw, lead(h) over o as qh from b window o as (partition by image_id order by y, x, box_id))"


@query("select image_id, box_id, case when iw > 0 and ih > 0 then (iw * ih)::double / (w * h + qw * qh - iw * ih) else 0.0::double end as iou, greatest(0, iw)::double / least(w, qw) as x_overlap, greatest(0, ih)::double / least(h, qh) as y_overlap, (x <= qx and y <= qy and x + w >= qx + qw and y + h >= qy + qh) as contains, (qx + qw / 2 between x and x + w) and (qy + qh / 2 between y and y + h) as has_centre from (select *, least(x + w, qx + qw) - greatest(x, qx) as iw, least(y + h, qy + qh) - greatest(y, qy) as ih from nx where qx is not null)", X.BOXES, NEXT)
def box_overlaps(spark, d):
    o = W.partitionBy("image_id").orderBy("y", "x", "box_id")
    n = X.boxes(spark, d).select("*", *(F.lead(k).over(o).alias(f"q{k}") for k in "xywh")).where("qx is not null")
    a, b = G.of(""), G.of("q")
    return n.select("image_id", "box_id", G.iou(a, b).alias("iou"), G.overlap_ratio(a["x"], a["w"], b["x"], b["w"]).alias("x_overlap"), G.overlap_ratio(a["y"], a["h"], b["y"], b["h"]).alias("y_overlap"), G.contains(a, b).alias("contains"), G.point_in(a, b["x"] + b["w"] / 2, b["y"] + b["h"] / 2).alias("has_centre"))


@query("select w, h, greatest(32, (round_even(trunc(w * s)::int / 32.0::double, 0) * 32)::int) as cap_w, greatest(32, (round_even(trunc(h * s)::int / 32.0::double, 0) * 32)::int) as cap_h, (ceil(trunc(w * r)::int / 32.0::double) * 32)::int as canvas_w, (ceil(trunc(h * r)::int / 32.0::double) * 32)::int as canvas_h, least(greatest(1, round_even(w * 48.0::double / h, 0)::int), 640) as fit_w from (select *, least(1.0::double, 960.0::double / greatest(w, h)) as s, least(1280.0::double, 1.5::double * greatest(w, h)) / greatest(w, h) as r from (select distinct x + 20 as w, y + 20 as h from b))", X.BOXES)
def resize_plans(spark, d):
    s = X.boxes(spark, d).select((F.col("x") + 20).alias("w"), (F.col("y") + 20).alias("h")).distinct()
    w, h = F.col("w"), F.col("h")
    cap, canvas, fit = G.plan_cap(w, h), G.plan_canvas(w, h), G.plan_height(w, h)
    return s.select("w", "h", cap[0].alias("cap_w"), cap[1].alias("cap_h"), canvas["canvas_w"].alias("canvas_w"), canvas["canvas_h"].alias("canvas_h"), fit[0].alias("fit_w"))


@query("select p_partkey, (p_size / 255.0::double - 0.5::double) / 0.5::double as grey, (p_size / 255.0::double - 0.485::double) / 0.229::double as red, case when p_retailprice / 2000 > 0.9 then 'high' when p_retailprice / 2000 > 0.7 then 'medium' else 'low' end as band, exp(-((p_size - 25)::double ** 2 / 200.0::double)) as bell from part")
def pixel_values(spark, d):
    p = X.table(spark, d, "part")
    dx = (F.col("p_size") - 25).cast("double")
    return p.select("p_partkey", G.normalise_gray(F.col("p_size")).alias("grey"), G.normalise_rgb(F.col("p_size"), 0).alias("red"), G.band(F.col("p_retailprice") / 2000).alias("band"), G.gaussian(dx, F.lit(0.0), F.lit(10.0), F.lit(1.0)).alias("bell"))


# layout

FILTERED = f"f1 as (select * from b where w >= 2 and h >= 6 and h <= {int(0.5 * HT)} and w <= 0.98 * {WD} and w / h between 0.02 and 50 and not ((x <= 0 or y <= 0 or x + w >= {WD} or y + h >= {HT}) and (w > 0.5 * {WD} or h > 0.5 * {HT}))), f2 as (select * from (select *, median(h) over (partition by image_id) as m from f1) where h >= 0.15 * m and h <= 5 * m)"


@query("select image_id, box_id from f2 where confidence >= 0.3", X.BOXES, FILTERED)
def component_filter(spark, d):
    return layout.filter_components(X.boxes(spark, d), WD, HT).where("confidence >= 0.3").select("image_id", "box_id")


@query("select image_id, median(h) as median_h, median(w) as median_w, stddev_pop(h) as std_h, greatest(2, trunc(0.15::double * median(h))::int) as padding from b group by image_id", X.BOXES)
def text_metrics(spark, d):
    return layout.text_metrics(X.boxes(spark, d))


@query(f"select image_id, n, case when n < 3 then 0.0 else n * (1 / (1 + sh / greatest(mh, 1.0))) * (case when mh between 8 and 100 then 1.0 else 0.5 end) * (case when mar > 0.3 and mar < 3 then 1.0 else 0.5 end) end::double as score from (select image_id, count(*) as n, median(h)::double as mh, stddev_pop(h) as sh, median(w / h) as mar from b where w / h > 0.1 and w / h < 10 and h < 0.3 * {HT} group by image_id)", X.BOXES)
def binarisation_score(spark, d):
    return layout.binarisation_score(X.boxes(spark, d), HT)


@query("select image_id, candidate, rank from (select image_id, candidate, row_number() over (partition by image_id order by score desc, candidate)::int as rank from (select image_id, box_id % 5 as candidate, round(sum(confidence), 6) - 10 as score from b group by all) where score > 0) where rank <= 3", X.BOXES)
def top_candidates(spark, d):
    s = X.boxes(spark, d).groupBy("image_id", (F.col("box_id") % 5).alias("candidate")).agg((F.round(F.sum("confidence"), 6) - 10).alias("score"))
    return layout.top_candidates(s).select("image_id", "candidate", "rank")


SUPPRESS = """s0 as (select *, row_number() over (partition by image_id order by confidence desc, box_id) as rn from b),
s1 as (select image_id, rn, [{'id': box_id, 'x': x, 'y': y, 'w': w, 'h': h}] as kept from s0 where rn = 1 union all
 select s0.image_id, s0.rn, case when len(list_filter(s1.kept, lambda k: (case when least(k.x + k.w, s0.x + s0.w) > greatest(k.x, s0.x) and least(k.y + k.h, s0.y + s0.h) > greatest(k.y, s0.y)
 then ((least(k.x + k.w, s0.x + s0.w) - greatest(k.x, s0.x)) * (least(k.y + k.h, s0.y + s0.h) - greatest(k.y, s0.y)))::double / (k.w * k.h + s0.w * s0.h - (least(k.x + k.w, s0.x + s0.w) - greatest(k.x, s0.x)) * (least(k.y + k.h, s0.y + s0.h) - greatest(k.y, s0.y))) else 0 end) > 0.1)) > 0
 then s1.kept else list_append(s1.kept, {'id': s0.box_id, 'x': s0.x, 'y': s0.y, 'w': s0.w, 'h': s0.h}) end from s1 join s0 on s0.image_id = s1.image_id and s0.rn = s1.rn + 1)"""


@query("select image_id, unnest(list_transform(kept, lambda k: k.id)) as box_id from (select image_id, arg_max(kept, rn) as kept from s1 group by image_id)", X.BOXES, SUPPRESS, recursive=True)
def suppression(spark, d):
    return layout.suppress(X.boxes(spark, d), 0.1).select("image_id", "box_id")


def lines_sql(test: str, inside: str) -> str:
    return f"""l0 as (select *, y + h / 2 as cy, median(h) over (partition by image_id) as mh from b),
l1 as (select *, row_number() over (partition by image_id order by cy, box_id) as rn from l0),
l2 as (select image_id, box_id, rn, 0 as line, cy::double as sc, h::double as sh, 1 as n from l1 where rn = 1 union all
 select l1.image_id, l1.box_id, l1.rn, case when {test} then l2.line else l2.line + 1 end, case when {test} then l2.sc + l1.cy else l1.cy end, case when {test} then l2.sh + l1.h else l1.h end, case when {test} then l2.n + 1 else 1 end
 from l2 join l1 on l1.image_id = l2.image_id and l1.rn = l2.rn + 1),
l3 as (select l2.image_id, l2.box_id, l2.line, x, y, w, h, confidence, row_number() over (partition by l2.image_id, l2.line order by {inside}, l2.box_id)::int as ordinal from l2 join b on b.image_id = l2.image_id and b.box_id = l2.box_id)"""


GROUPED = lines_sql("abs(l1.cy - l2.sc / l2.n) <= greatest(0.6::double * l1.mh, 0.5::double * (l2.sh / l2.n))", "x")
LINE = "select image_id, box_id, line, ordinal from l3"


@query(LINE, X.BOXES, GROUPED, recursive=True)
def line_groups(spark, d):
    return layout.group_lines(X.boxes(spark, d)).select("image_id", "box_id", "line", "ordinal")


@query(LINE, X.BOXES, lines_sql("abs(l1.cy - l2.sc / l2.n) < 0.7::double * l1.mh", "x + w / 2"), recursive=True)
def reading_order(spark, d):
    return layout.reading_order(X.boxes(spark, d)).select("image_id", "box_id", "line", "ordinal")


@query(LINE, X.BOXES, lines_sql("abs(l1.cy - l2.sc / l2.n) < 0.8::double * l1.mh", "x"), recursive=True)
def reading_order_left(spark, d):
    return layout.reading_order(X.boxes(spark, d), 0.8, False).select("image_id", "box_id", "line", "ordinal")


ENVELOPES = f"e0 as (select image_id, line, min(x) as x1, min(y) as y1, max(x + w) as x2, max(y + h) as y2, avg(confidence) as confidence, count(*) as n from l3 group by all), e1 as (select image_id, line, greatest(0, x1 - 3) as x, greatest(0, y1 - 3) as y, least({WD} - greatest(0, x1 - 3), x2 - x1 + 6) as w, least({HT} - greatest(0, y1 - 3), y2 - y1 + 6) as h, confidence, n from e0)"


def line_boxes_of(spark: SparkSession, d: str) -> DataFrame:
    return layout.envelopes(layout.group_lines(X.boxes(spark, d)), ["image_id", "line"], 3, WD, HT)


@query("select * from e1", X.BOXES, GROUPED, ENVELOPES, recursive=True)
def line_boxes(spark, d):
    return line_boxes_of(spark, d)


WORDS = "w0 as (select *, x - lag(x + w) over (partition by image_id, line order by x, box_id) as gap from l3), w1 as (select *, median(w) over p as mw, count(gap) over p as ng, median(gap) over p as mg, stddev_pop(gap) over p as sg from w0 window p as (partition by image_id, line)), w2 as (select *, least(greatest(case when ng >= 3 then mg + sg else 0.5::double * mw end, 0.3::double * mw), 2.0::double * mw) as thr from w1)"


@query("select image_id, line, box_id, sum(case when gap > thr then 1 else 0 end) over (partition by image_id, line order by x, box_id)::int as word from w2", X.BOXES, GROUPED, WORDS, recursive=True)
def word_segments(spark, d):
    return layout.words(layout.group_lines(X.boxes(spark, d))).select("image_id", "line", "box_id", "word")


BLOCKS = "k0 as (select *, lag(x) over o as px, lag(w) over o as pw, y - lag(y + h) over o as gap from e1 window o as (partition by image_id order by y, line)), k1 as (select *, greatest(2.0::double * median(gap) over (partition by image_id), 20.0) as lim from k0), k2 as (select *, case when gap is null or (gap <= lim and greatest(0, least(x + w, px + pw) - greatest(x, px))::double / least(w, pw) > 0.3) then 0 else 1 end as new from k1)"


@query("select image_id, line, sum(new) over (partition by image_id order by y, line)::int as block from k2", X.BOXES, GROUPED, ENVELOPES, BLOCKS, recursive=True)
def block_groups(spark, d):
    return layout.group_blocks(line_boxes_of(spark, d)).select("image_id", "line", "block")


TREE = "y0 as (select *, sum(case when gap > thr then 1 else 0 end) over (partition by image_id, line order by x, box_id)::int as word from w2), y1 as (select image_id, line, word, string_agg(box_id::varchar, ',' order by x, box_id) as ids from y0 group by all), y2 as (select image_id, line, string_agg(ids, ' ' order by word) as ids from y1 group by all), y3 as (select image_id, line, sum(new) over (partition by image_id order by y, line)::int as block from k2)"


@query("select image_id, block, string_agg(line::varchar || ':' || ids, '/' order by line) as lines from y3 join y2 using (image_id, line) group by image_id, block", X.BOXES, GROUPED, WORDS, ENVELOPES, BLOCKS, TREE, recursive=True)
def hierarchy(spark, d):
    tree = layout.hierarchy(X.boxes(spark, d), WD, HT)
    ids = lambda w: F.array_join(w["box_ids"].cast("array<string>"), ",")
    return tree.select("image_id", "block", F.array_join(F.transform("lines", lambda x: F.concat(x["line"].cast("string"), F.lit(":"), F.array_join(F.transform(x["words"], ids), " "))), "/").alias("lines"))


@query(f"select image_id, box_id, w >= 2 and h >= 6 and s > 0.2 and s < 0.95 as stable, 0.7::double * s as stable_confidence, w * h > 10 and w / h > 0.05 and w / h < 15 as gradient, 0.5::double * least(1.0::double, greatest(0.0::double, 1 - h / (w + 1e-6::double))) as gradient_confidence, w >= 2 and h >= 3 and w * h >= 6 and x > 0 and y > 0 and x + w < {WD} and y + h < {HT} as inner_part from (select *, confidence / 10 * 10 as s from b)", X.BOXES)
def region_filters(spark, d):
    b = X.boxes(spark, d).withColumn("s", F.col("confidence") / 10 * 10)
    stable, stable_c = G.stable_region("w", "h", "s")
    strong, strong_c = G.gradient_region("w", "h", F.col("w") * F.col("h"), "w", "h")
    return b.select("image_id", "box_id", stable.alias("stable"), stable_c.alias("stable_confidence"), strong.alias("gradient"), strong_c.alias("gradient_confidence"), G.inner_component(F.col("w") * F.col("h"), WD, HT).alias("inner_part"))


@query("select image_id, box_id, x + 1.5::double as left_x, y::double as left_y, x + w - 2.5::double as right_x, y + h::double as right_y from b where w >= 5 and h >= 5", X.BOXES)
def quad_corners(spark, d):
    q = quads(X.boxes(spark, d)).where("w >= 5 and h >= 5").withColumn("c", G.corner_order(F.col("quad")))
    return q.select("image_id", "box_id", F.col("c")[0]["x"].alias("left_x"), F.col("c")[0]["y"].alias("left_y"), F.col("c")[2]["x"].alias("right_x"), F.col("c")[2]["y"].alias("right_y"))


MERGED = """m0 as (select *, row_number() over (partition by image_id order by y, box_id) as rn from b),
m1 as (select image_id, rn, 0 as pos, x, y, w, h, confidence::double as confidence from m0 where rn = 1 union all
 select m0.image_id, m0.rn, case when hit then m1.pos else m1.pos + 1 end, case when hit then least(m1.x, m0.x) else m0.x end, case when hit then least(m1.y, m0.y) else m0.y end,
 case when hit then greatest(m1.x + m1.w, m0.x + m0.w) - least(m1.x, m0.x) else m0.w end, case when hit then greatest(m1.y + m1.h, m0.y + m0.h) - least(m1.y, m0.y) else m0.h end,
 case when hit then (m1.confidence + m0.confidence) / 2 else m0.confidence end
 from m1 join m0 on m0.image_id = m1.image_id and m0.rn = m1.rn + 1, lateral (select greatest(0, least(m1.y + m1.h, m0.y + m0.h) - greatest(m1.y, m0.y))::double / least(m1.h, m0.h) > 0.3 as hit) as hh)"""


@query("select image_id, pos, arg_max(x, rn) as x, arg_max(y, rn) as y, arg_max(w, rn) as w, arg_max(h, rn) as h, arg_max(confidence, rn) as confidence from m1 group by image_id, pos", X.BOXES, MERGED, recursive=True)
def vertical_merge(spark, d):
    return layout.merge_vertical(X.boxes(spark, d))


SPACE = "g as (select a.image_id, a.box_id, any_value(a.x) as x, any_value(a.y) as y, any_value(a.w) as w, any_value(a.h) as h, min(case when least(a.y + a.h, c.y + c.h) > greatest(a.y, c.y) then greatest(0, c.x - (a.x + a.w), a.x - (c.x + c.w)) end) as gap_x, min(case when least(a.x + a.w, c.x + c.w) > greatest(a.x, c.x) then greatest(0, c.y - (a.y + a.h), a.y - (c.y + c.h)) end) as gap_y from b a left join b c on a.image_id = c.image_id and a.box_id <> c.box_id group by a.image_id, a.box_id)"


@query("select image_id, box_id, gap_x, gap_y from g", X.BOXES, SPACE)
def free_space(spark, d):
    return layout.free_space(X.boxes(spark, d)).select("image_id", "box_id", "gap_x", "gap_y")


@query("select image_id, box_id, trunc(x + w / 2 - a / 2)::int as x1, trunc(y + h / 2 - dn / 2)::int as y1, trunc(x + w / 2 + a / 2)::int as x2, trunc(y + h / 2 + dn / 2)::int as y2 from (select *, case when w >= h then nw else nh end as a, case when w >= h then nh else nw end as dn from (select *, greatest(w, h)::double + least(greatest(w, h)::double * 0.01::double + least(w, h)::double * 0.5::double + 5, coalesce(gap_x::double, 1e18)) as nw, least(w, h)::double + least(least(w, h)::double * 0.05::double + 5, coalesce(gap_y::double, 1e18)) as nh from g))", X.BOXES, SPACE)
def smart_padding(spark, d):
    return layout.smart_padding(X.boxes(spark, d))


def frames_of_page(boxes: DataFrame) -> DataFrame:
    return boxes.select("image_id", "box_id", "x", "y", (F.col("w") * 6).alias("w"), (F.col("h") * 8).alias("h"))


OUTER = "ob as (select image_id, box_id as outer_id, x, y, w * 6 as w, h * 8 as h from b)"


@query("select ob.image_id, outer_id, b.box_id as inner_id from ob join b on ob.image_id = b.image_id where ob.x <= b.x and ob.y <= b.y and ob.x + ob.w >= b.x + b.w and ob.y + ob.h >= b.y + b.h", X.BOXES, OUTER)
def members_inside(spark, d):
    b = X.boxes(spark, d)
    return layout.members(frames_of_page(b), b, False)


@query("select ob.image_id, outer_id, b.box_id as inner_id from ob join b on ob.image_id = b.image_id where (b.x + b.w / 2 between ob.x and ob.x + ob.w) and (b.y + b.h / 2 between ob.y and ob.y + ob.h)", X.BOXES, OUTER)
def members_centre(spark, d):
    b = X.boxes(spark, d)
    return layout.members(frames_of_page(b), b, True)


ASSEMBLED = "t0 as (select *, y + h / 2 as cy, lag(y + h / 2) over o as pc, lag(h) over o as ph from {rows} window o as (partition by image_id order by line_number)), t1 as (select *, sum(case when pc is null or abs(cy - pc) < 0.8::double * greatest(h, ph) then 0 else 1 end) over (partition by image_id order by line_number)::int as text_line from t0)"


@query("select image_id, string_agg(line, chr(10) order by text_line) as text from (select image_id, text_line, string_agg(text, ' ' order by line_number) as line from t1 group by all) group by image_id", X.BOXES, X.REGIONS, ASSEMBLED.format(rows="rg"))
def document_text(spark, d):
    return layout.document_text(X.regions(spark, d))


@query("select image_id, line_number, string_agg(lead_ || text, '') over (partition by image_id order by line_number) as cumulative_text from (select *, case when pt is null then '' when pt = text_line then ' ' else chr(10) end as lead_ from (select *, lag(text_line) over (partition by image_id order by line_number) as pt from t1))", X.BOXES, X.REGIONS, "kr as (select * from rg where error is null and length(text) > 0)", ASSEMBLED.format(rows="kr"))
def cumulative_text(spark, d):
    return layout.cumulative_text(X.regions(spark, d)).select("image_id", "line_number", "cumulative_text")


# decoding

SOFT = "sm as (select *, list_position(logits, list_max(logits)) - 1 as id, 1 / list_sum(list_transform(logits, lambda v: exp(v - list_max(logits)))) as p from fr)"


@query("select image_id, coalesce(string_agg((id - 2)::varchar, ' ' order by t) filter (emit), '') as ids, count(*) filter (emit)::int as length, avg(p) as confidence from (select *, id >= 2 and (pid is null or pid <> id) as emit from (select *, lag(id) over (partition by image_id order by t) as pid from sm)) group by image_id", X.FRAMES, SOFT)
def ctc_decode(spark, d):
    return decode.ctc_collapse(X.frames(spark, d)).withColumn("ids", F.concat_ws(" ", F.col("ids").cast("array<string>")))


@query("select doc, least(1.0::double, exp(avg(-abs(value) / 100))) as confidence from tk group by doc", X.TOKENS)
def sequence_confidence(spark, d):
    return decode.sequence_confidence(X.tokens(spark, d).withColumn("lp", -F.abs("value") / 100), "doc", "lp")


@query("select doc, step, token, string_agg(token, '') over (partition by doc order by step) as cumulative_text from tk", X.TOKENS)
def running_tokens(spark, d):
    return decode.running_text(X.tokens(spark, d)).select("doc", "step", "token", "cumulative_text")


@query("select doc, step, coalesce(token = t1 and token = t2, false) as triple, coalesce(token = t2 and t1 = t3, false) as pair, coalesce(token = t3 and t1 = t4 and t2 = t5, false) as trigram from (select *, lag(token, 1) over o as t1, lag(token, 2) over o as t2, lag(token, 3) over o as t3, lag(token, 4) over o as t4, lag(token, 5) over o as t5 from tk window o as (partition by doc order by step))", X.TOKENS)
def repeated_tokens(spark, d):
    return decode.repeats(X.tokens(spark, d)).select("doc", "step", "triple", "pair", "trigram")


@query("select doc, step, dense_rank() over (partition by doc order by region)::int as region_number, lag(step) over r is null as region_start, lead(step) over r is null as region_finished, lead(step) over r is null and region = max(region) over (partition by doc) as document_finished from (select *, (step - 1) // 7 as region from tk) window r as (partition by doc, region order by step)", X.TOKENS)
def region_marks(spark, d):
    t = X.tokens(spark, d).withColumn("region", F.floor((F.col("step") - 1) / 7))
    return decode.mark_regions(t).select("doc", "step", "region_number", "region_start", "region_finished", "document_finished")


@query("select image_id, t, round(exp(logits[1] - mx) / s, 9) as p1, round(exp(logits[6] - mx) / s, 9) as p6, round(mx + ln(s), 9) as lse, round(1.35::double * (logits[2] - mx - ln(s)), 9) as fused2 from (select *, list_max(logits) as mx, list_sum(list_transform(logits, lambda v: exp(v - list_max(logits)))) as s from fr)", X.FRAMES)
def softmax_frames(spark, d):
    x = F.col("logits")
    p = X.frames(spark, d).select("image_id", "t", T.softmax(x).alias("p"), T.logsumexp(x).alias("lse"), T.fuse(x, x).alias("fused"))
    return p.select("image_id", "t", F.round(F.col("p")[0], 9).alias("p1"), F.round(F.col("p")[5], 9).alias("p6"), F.round("lse", 9).alias("lse"), F.round(F.col("fused")[1], 9).alias("fused2"))


@query("select p_partkey, pow((p_size::double + 5) / 6, 0.8::double) as batch, pow(p_size::double, 0.8::double) as stream, least(512, case when p_size > 10 then trunc(p_size * 1.3::double)::int + 10 else p_size + 10 end) as steps, 0.6::double * (p_size / 50) + 0.4::double * (p_retailprice / 2000) as confidence from part")
def decode_scores(spark, d):
    n = F.col("p_size")
    return X.table(spark, d, "part").select("p_partkey", T.length_penalty(n).alias("batch"), T.length_penalty(n, kind="stream").alias("stream"), T.max_steps(F.when(n > 10, n).otherwise(0), n).alias("steps"), T.final_confidence(n / 50, F.col("p_retailprice") / 2000).alias("confidence"))


@query()
def beam_decode(spark, d):
    return beam.decode(X.frames(spark, d))


@query()
def greedy_decode(spark, d):
    return beam.decode(X.frames(spark, d), beam=1)


@query("select image_id, step, token_id, ids, confidence, finished from (select image_id, row_number() over (partition by image_id order by t)::int as step, id as token_id, string_agg((id - 2)::varchar, ' ') over (partition by image_id order by t) as ids, p as confidence, false as finished from (select *, id >= 2 and (pid is null or pid <> id) as emit from (select *, lag(id) over (partition by image_id order by t) as pid from sm)) where emit union all select image_id, count(*) filter (emit)::int, -1, coalesce(string_agg((id - 2)::varchar, ' ' order by t) filter (emit), ''), avg(p), true from (select *, id >= 2 and (pid is null or pid <> id) as emit from (select *, lag(id) over (partition by image_id order by t) as pid from sm)) group by image_id)", X.FRAMES, SOFT)
def ctc_stream(spark, d):
    return decode.ctc_stream(X.frames(spark, d)).withColumn("ids", F.concat_ws(" ", F.col("ids").cast("array<string>")))


@query()
def greedy_stream(spark, d):
    return beam.decode_stream(X.frames(spark, d))


@query()
def beam_stream(spark, d):
    return beam.decode_stream(X.frames(spark, d), greedy=False)


# corpora

VOCAB = "vo as (select char, row_number() over (order by char)::int as id from (select distinct unnest(string_split(text, '')) as char from documents) where char <> '' union all select '<unk>', 0)"


@query("select * from vo", VOCAB)
def vocabulary(spark, d):
    return corpus.vocabulary(X.table(spark, d, "documents"))


@query("select part_.doc_id, '1 ' || string_agg((coalesce(vo.id, 0) + 3)::varchar, ' ' order by part_.i) || ' 2' as ids from (select doc_id, unnest(range(length(t))) as i, unnest(string_split(t, '')) as ch from (select doc_id, text as t from documents)) part_ left join vo on vo.char = part_.ch group by part_.doc_id", VOCAB)
def tokenise(spark, d):
    docs = X.table(spark, d, "documents")
    return corpus.tokenise(docs.select("doc_id", "text"), corpus.vocabulary(docs)).select("doc_id", F.concat_ws(" ", F.col("ids").cast("array<string>")).alias("ids"))


@query("select doc_id, text from documents")
def detokenise(spark, d):
    docs = X.table(spark, d, "documents")
    v = corpus.vocabulary(docs)
    chars = v.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "char"))), lambda s: s["char"]).alias("characters"))
    ids = corpus.tokenise(docs.select("doc_id", "text"), v)
    return ids.crossJoin(F.broadcast(chars)).select("doc_id", T.decode(F.col("ids"), F.col("characters")).alias("text"))


@query("select batch, max(len(cut))::int as width, array_to_string(flatten(list(cut || list_transform(range(0, (w - len(cut))::bigint), lambda v: 0) order by step)), ' ') as targets, array_to_string(flatten(list(cut order by step)), ' ') as flat, string_agg(len(cut)::varchar, ' ' order by step) as lengths from (select *, max(len(cut)) over (partition by batch) as w from (select batch, step, list_transform(range(0, (step % 5 + 1)::bigint), lambda v: step) as cut from (select p_partkey + 1 as step, p_partkey // 4 as batch from part))) group by batch")
def padded_batches(spark, d):
    t = X.table(spark, d, "part").select((F.col("p_partkey") + 1).alias("row")).select("row", F.array_repeat("row", (F.col("row") % 5 + 1).cast("int")).alias("ids"))
    text = lambda a: F.concat_ws(" ", a.cast("array<string>"))
    return corpus.batches(t, 4).select("batch", "width", text(F.flatten("targets")).alias("targets"), text(F.col("flat")).alias("flat"), text(F.col("lengths")).alias("lengths"))


UNIT = "(('0x' || substring(md5(doc_id::varchar || ':{seed}'), 1, 8))::bigint::double / 4294967296.0::double)"


@query(f"select doc_id, case when {UNIT.format(seed=42)} < 0.1 then 'val' else 'train' end as part from documents union all select doc_id, 'train' from documents where {UNIT.format(seed=42)} < 0.1")
def split_with_leak(spark, d):
    return corpus.split(X.table(spark, d, "documents"), "doc_id", leak=True).select("doc_id", "part")


@query(f"select doc_id from documents order by {UNIT.format(seed=42)}, doc_id limit 50")
def reservoir(spark, d):
    return corpus.sample(X.table(spark, d, "documents").select("doc_id"), "doc_id", 50)


@query(f"select doc_id, case when u < 0.3::double / 1.0 then 'paragraph' when u < (0.3::double + 0.25::double) / 1.0 then 'invoice' when u < (0.3::double + 0.25::double + 0.2::double) then 'form' when u < (0.3::double + 0.25::double + 0.2::double + 0.12::double) then 'table' when u < (0.3::double + 0.25::double + 0.2::double + 0.12::double + 0.08::double) then 'list' else 'header' end as layout from (select doc_id, {UNIT.format(seed='layout')} as u from documents)")
def weighted_layouts(spark, d):
    return X.table(spark, d, "documents").select("doc_id", corpus.choose(F.col("doc_id"), {"paragraph": 0.3, "invoice": 0.25, "form": 0.2, "table": 0.12, "list": 0.08, "header": 0.05}, "layout").alias("layout"))


@query("select l.text, greatest(0, l.need - coalesce(h.have, 0))::bigint as remaining from (select line as text, 2 * count(*) as need from ln where length(line) > 0 group by line) l left join (select line as text, count(*) as have from ln where lang = 'en' group by line) h on l.text = h.text", X.LINES)
def resume_counts(spark, d):
    lines = X.lines(spark, d)
    return corpus.remaining(lines.where(F.length("line") > 0).select(F.col("line").alias("text")), lines.where("lang = 'en'").select(F.col("line").alias("text")), 2)


@query("select n_name, r_name as font, copy::int as copy from nation, region, (select unnest([1, 2, 3]) as copy)")
def lines_by_fonts(spark, d):
    return corpus.expand(corpus.with_fonts(X.table(spark, d, "nation").select("n_name"), X.table(spark, d, "region").select(F.col("r_name").alias("font"))), 3)


@query("select doc_id, coalesce(case lang when 'en' then 'latin' when 'fr' then 'accented' end, 'any') as pool from documents")
def pools(spark, d):
    p = spark.sql("select * from values ('en', 'latin'), ('fr', 'accented'), ('default', 'any') as t(lang, pool)")
    return corpus.pool_of(X.table(spark, d, "documents").select("doc_id", "lang"), p, "lang").select("doc_id", "pool")


# sources and sinks



@query("select 'img' || doc_id || '_' || pos || '.png' as image, regexp_replace(string_split(regexp_replace('img' || doc_id || '_' || pos || '.png' || chr(9) || replace(line, ' of ', chr(9)), '\\s+$', ''), chr(9))[2], '^$', '') as text from ln where len(string_split(regexp_replace('img' || doc_id || '_' || pos || '.png' || chr(9) || replace(line, ' of ', chr(9)), '\\s+$', ''), chr(9))) >= 2", X.LINES)
def label_rows(spark, d):
    value = F.concat(F.lit("img"), F.col("doc_id").cast("string"), F.lit("_"), F.col("pos").cast("string"), F.lit(".png\t"), F.replace(F.col("line"), F.lit(" of "), F.lit("\t")))
    return readers.parse_labels(X.lines(spark, d).select(value.alias("value")))


@query("select doc_id, pos, line from ln where length(trim(line)) > 0", X.LINES)
def non_blank_lines(spark, d):
    return X.lines(spark, d).withColumn("line", F.col("line")).where(F.length(T.strip(F.col("line"))) > 0).select("doc_id", "pos", "line")


@query("select image_id, line_number, case when confidence > 0.9 then '#28a745' when confidence > 0.7 then '#ffc107' else '#dc3545' end as colour, substring(text, 1, 50) || ' (' || round_even(confidence * 100, 0)::int::varchar || '%)' as label from rg", X.BOXES, X.REGIONS)
def region_labels(spark, d):
    return writers.annotations(X.regions(spark, d)).select("image_id", "line_number", "colour", "label")


@query("select c_custkey, lpad(c_custkey::varchar, 6, '0') || '.png' || chr(9) || c_name as value from customer")
def label_lines(spark, d):
    c = X.table(spark, d, "customer")
    return c.select("c_custkey", F.concat(F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit(".png\t"), "c_name").alias("value"))


#: Texts of these regions have nothing to escape.
CARDS = "cd as (select image_id, string_agg(printf('<div class=\"%s\">%d: %s</div>', case when confidence > 0.9 then 'high' when confidence > 0.7 then 'medium' else 'low' end, line_number, text), '' order by line_number) as cards, count(*) as total, count(*) filter (confidence > 0.9) as high, count(*) filter (confidence > 0.7 and confidence <= 0.9) as medium, count(*) filter (confidence <= 0.7) as low from rg group by image_id), dt as (select image_id, string_agg(line, chr(10) order by text_line) as text from (select image_id, text_line, string_agg(text, ' ' order by line_number) as line from t1 group by all) group by image_id)"


@query("select image_id, '<html><body><p>' || concat_ws(' / ', total, high, medium, low) || '</p><pre>' || text || '</pre>' || cards || '</body></html>' as html from cd join dt using (image_id)", X.BOXES, X.REGIONS, ASSEMBLED.format(rows="rg"), CARDS)
def html_reports(spark, d):
    return writers.report(X.regions(spark, d))


@query("select image_id, '[' || string_agg('{\"line_number\":' || line_number || ',\"box\":[' || x || ',' || y || ',' || w || ',' || h || '],\"text\":\"' || text || '\",\"confidence\":' || confidence || '}', ',' order by line_number) || ']' as json from rg group by image_id", X.BOXES, X.REGIONS)
def json_results(spark, d):
    return writers.results_json(X.regions(spark, d))


@query("select p_partkey, case lower(m) when 'fast' then 'ctc' when 'beam' then 'beam' else 'decoder' end as method from (select p_partkey, ['Fast', 'accurate', 'BEAM'][(p_partkey % 3)::int + 1] as m from part)")
def decode_methods(spark, d):
    p = X.table(spark, d, "part")
    return p.select("p_partkey", models.method(F.element_at(F.array(F.lit("Fast"), F.lit("accurate "), F.lit("BEAM")), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("method"))


@query("select image_id, line_number, upper(text) as text, 0.5::double as confidence from rg", X.BOXES, X.REGIONS)
def stub_recogniser(spark, d):
    make = lambda: lambda b: [(t.upper(), 0.5) for t in b["source"]]
    return models.recognise(X.regions(spark, d).withColumn("source", F.col("text")), ("stub",), make).select("image_id", "line_number", "text", "confidence")


# pixels

PIXELS = "px as (select (o_custkey % 40)::int as image_id, (o_orderkey * 31 % 64 + (case when o_orderkey % 3 = 0 then 150 else 20 end))::int as v from orders)"


def pixels(spark: SparkSession, d: str) -> DataFrame:
    o = X.table(spark, d, "orders")
    return o.select((F.col("o_custkey") % 40).cast("int").alias("image_id"), (F.col("o_orderkey") * 31 % 64 + F.when(F.col("o_orderkey") % 3 == 0, 150).otherwise(20)).cast("int").alias("v"))


@query("select image_id, v as threshold from (select *, row_number() over (partition by image_id order by bt desc, v) as rk from (select *, case when n - n0 > 0 then n0 * (n - n0)::double * (s0 / n0 - (s - s0) / (n - n0)) * (s0 / n0 - (s - s0) / (n - n0)) else 0 end as bt from (select image_id, v, sum(c) over u as n0, sum(c * v) over u as s0, sum(c) over a as n, sum(c * v) over a as s from (select image_id, v, count(*) as c from px group by all) window u as (partition by image_id order by v rows unbounded preceding), a as (partition by image_id)))) where rk = 1", PIXELS)
def otsu_threshold(spark, d):
    return raster.otsu(pixels(spark, d))


@query("select image_id, case when avg(v) over (partition by image_id) < 127 then 255 - v else v end as v from px", PIXELS)
def invert_dark(spark, d):
    return raster.invert_dark(pixels(spark, d))


#: Character boxes, on a page of an eighth of the size.
CHARS = "ch as (select image_id, box_id, x // 8 as x, y // 8 as y, greatest(1, w // 8) as w, greatest(1, h // 8) as h from b)"


def characters(spark: SparkSession, d: str) -> DataFrame:
    eighth = lambda k, least: F.greatest(F.lit(least), F.floor(F.col(k) / 8).cast("int")).alias(k)
    return X.boxes(spark, d).select("image_id", "box_id", eighth("x", 0), eighth("y", 0), eighth("w", 1), eighth("h", 1))


MAP = "mp as (select image_id, px, py, round(max(exp(-((px - (x + w / 2)) ** 2 / (2 * greatest(w / 2.5, 1.0::double) ** 2) + (py - (y + h / 2)) ** 2 / (2 * greatest(h / 2.5, 1.0::double) ** 2)))), 9) as value from (select *, unnest(range(greatest(0, y - trunc(h * 0.2)::int), least(1700, y + h + trunc(h * 0.2)::int))) as py from (select *, unnest(range(greatest(0, x - trunc(w * 0.2)::int), least(1280, x + w + trunc(w * 0.2)::int))) as px from ch)) group by all)"


@query("select image_id, count(*) as n, round(sum(value), 4) as total, max(value) as top from mp group by image_id", X.BOXES, CHARS, MAP)
def region_maps(spark, d):
    return raster.map_totals(characters(spark, d), WD, HT).withColumn("total", F.round("total", 4))


@query("select image_id, box_id, n_id as next_id, (cx + n_cx) / 2 as mid_x, (cy + n_cy) / 2 as mid_y, abs(n_cx - cx) as w, (h + n_h) / 2 as h from (select *, lead(box_id) over o as n_id, lead(cx) over o as n_cx, lead(cy) over o as n_cy, lead(w) over o as n_w, lead(h) over o as n_h from (select *, x + w / 2 as cx, y + h / 2 as cy from b) window o as (partition by image_id order by box_id)) where n_id is not null and abs(cy - n_cy) <= 20 and abs(n_cx - cx) <= 3 * (w + n_w) / 2", X.BOXES)
def affinity_pairs(spark, d):
    return raster.affinity_pairs(X.boxes(spark, d))


@query("select ch.image_id, ch.box_id, round(avg(value), 6) as score from ch join mp on mp.image_id = ch.image_id and px >= ch.x and px < ch.x + ch.w and py >= ch.y and py < ch.y + ch.h group by all", X.BOXES, CHARS, MAP)
def box_scores(spark, d):
    return raster.box_map_scores(characters(spark, d), WD, HT).withColumn("score", F.round("score", 6))


def images(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").cast("int").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("embedding").cast("array<double>").alias("values"))


# streams over stored rows, run to their end


@query("select doc, string_agg(token, '' order by step) as text, count(*) as steps from tk group by doc", X.TOKENS)
def final_texts(spark, d):
    return running.final_texts(decode.running_text(X.tokens(spark, d)))


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, sum(value) as total from events group by all")
def event_windows(spark, d):
    return running.event_windows(X.table(spark, d, "events"))


from vellum.plans import box_queries, corpus_queries, pixel_queries  # noqa: E402, F401  they register theirs, some on top of these
