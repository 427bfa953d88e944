"""What keeps queries whole on large tables: how joins and exchanges are planned, and how much a step holds at once."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.operators import batches, corpus, raster, vision
from vellum.plans.queries import QUERIES


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_filled_pages_are_not_broadcast(spark, tiny):
    assert "Broadcast" not in plan_of(QUERIES["filled_pages"](spark, tiny))


ODD = [(1, 1, 0, 0, 9, 3), (1, 2, 5, 1, 4, 8), (1, 3, 5, 1, 4, 8), (2, 1, 30, 20, 60, 40), (2, 2, 75, 2, 3, 3), (3, 1, 90, 90, 5, 5), (4, 1, None, 1, 2, 2), (None, 1, 3, 3, 6, 6), (None, 2, 8, 3, 6, 6)]


def odd_boxes(spark):
    return spark.createDataFrame(ODD, "image_id int, box_id int, x int, y int, w int, h int")


def same(got, want):
    key = lambda r: tuple(repr(None if v is None else round(v, 6)) for v in r)
    return sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def exchanges(frame):
    return plan_of(frame).count("Exchange hashpartitioning")


def test_quads_on_maps(spark, tiny, monkeypatch):
    monkeypatch.setattr(raster, "PIXELS", 50)
    q = odd_boxes(spark).withColumn("points", F.expr("array(%s)" % ", ".join(f"named_struct('x', {a}, 'y', {b})" for a, b in (("x", "y"), ("x + w", "y"), ("x + w", "y + h + 1"), ("x - 1", "y + h")))))
    m = raster.region_map(q, 80, 64).withColumn("value", F.round("value", 9))
    known = q.where("image_id is not null and x is not null")
    got = raster.quad_map_scores(q, 80, 64)
    assert same(got.where("image_id is not null and image_id <> 4"), raster.quad_scores(m, known.select("image_id", "box_id", "points")))
    assert [r.score for r in got.where("image_id = 4").collect()] == [0.0]
    assert exchanges(QUERIES["quad_scores"](spark, tiny)) == 1


def test_boxes_on_maps(spark, tiny, monkeypatch):
    monkeypatch.setattr(raster, "PIXELS", 50)
    b = odd_boxes(spark)
    m = raster.region_map(b, 80, 64).withColumn("value", F.round("value", 9))
    assert same(raster.box_map_scores(b, 80, 64).where("image_id is not null"), raster.box_scores(m, b.where("image_id is not null and x is not null")))
    assert exchanges(QUERIES["box_scores"](spark, tiny)) == 1


def test_columns_of_maps(spark, tiny, monkeypatch):
    monkeypatch.setattr(raster, "PIXELS", 50)
    b = odd_boxes(spark)
    m = raster.region_map(b, 80, 64).where(F.round("value", 9) > 0.6)
    assert same(raster.map_columns(b, 80, 64, 0.6), raster.column_extents(m)) and raster.map_columns(b, 80, 64, 2.0).count() == 0
    assert exchanges(QUERIES["column_extents"](spark, tiny)) == 1


def test_totals_of_maps(spark, tiny, monkeypatch):
    monkeypatch.setattr(raster, "PIXELS", 50)
    b = odd_boxes(spark)
    m = raster.region_map(b, 80, 64).withColumn("value", F.round("value", 9))
    assert same(raster.map_totals(b, 80, 64), m.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("top")))
    assert not {"py", "px"} & set(plan_of(QUERIES["region_maps"](spark, tiny)).replace("#", " ").split())


def test_code_points_come_in_pieces(spark, monkeypatch):
    texts = ["ab" * 30, None, "", "é😀" * 20, "x", "y" * 200]
    batch = pa.record_batch([pa.array(range(6)), pa.array(texts)], names=["id", "text"])
    monkeypatch.setattr(corpus, "TEXT", 64)
    got = [p.column(1).to_pylist() for p in corpus.pieces(batch, 1)]
    assert sum(got, []) == texts and len(got) > 3
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 64 for p in got)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    ids = {r.id: r.ids for r in corpus.tokenise(df, corpus.vocabulary(df)).collect()}
    assert ids[1] is None and ids[2] == [1, 2] and [len(ids[k]) for k in (0, 3, 4, 5)] == [62, 42, 3, 202]


def test_detokenised_texts_come_in_pieces(spark, tiny, monkeypatch):
    monkeypatch.setattr(corpus, "TEXT", 500)
    want = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    got = QUERIES["detokenise"](spark, tiny)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_images_are_binarised_together(spark, monkeypatch):
    g = np.random.default_rng(3)
    for h, w in ((4, 4), (9, 13), (20, 30), (3, 5), (40, 9)):
        v = np.clip(g.normal(120, 50, (20, h, w)), 0, 255).astype(np.uint8) // 30 * 30
        assert (vision.equalised_all(v) == np.stack([vision.equalised(i) for i in v])).all()
        assert vision.otsu_all(v).reshape(-1).tolist() == [vision.otsu(i) for i in v]
    images = [(k, w, h, c, g.integers(0, 256, w * h * c).tolist()) for k, (w, h, c) in enumerate([(4, 4, 3), (5, 3, 1), (4, 4, 3), (8, 8, 1), (40, 20, 3)])]
    df = spark.createDataFrame(images, "image_id int, width int, height int, channels int, values array<int>").coalesce(1)
    got = {(r.image_id, r.candidate): (r.on, r["values"]) for r in vision.binarise(df).collect()}
    want = {}
    for k, w, h, c, values in images:
        v = np.array(values, np.uint8).reshape((h, w, c) if c > 1 else (h, w))
        want |= {(k, name): (int(m.sum()), m.reshape(-1).tolist()) for name, m in vision.candidates(v).items()}
    assert got == want
    calls = []
    monkeypatch.setattr(vision, "equalised", lambda *a: calls.append(a))
    assert len(vision.candidates_all(np.zeros((500, 4, 4, 3), np.uint8), True)) == 26 and not calls


def test_pieces_of_text_are_small():
    texts = ["é" * 1000, "x" * 3_000_000, None, *["ab" * 1500] * 3000]
    sizes = [(p.num_rows, sum(len(t or "") for t in p.column(0).to_pylist())) for p in corpus.pieces(pa.record_batch([pa.array(texts)], names=["text"]), 0)]
    assert sum(n for n, _ in sizes) == len(texts) and sum(n for _, n in sizes) == 1000 + 12_000_000
    assert max(n for rows, n in sizes if rows > 2) <= 1 << 20


@pytest.mark.parametrize("name, deals", [("detected_words", 3), ("detected_lines", 3), ("detected_blocks", 4), ("multiline_images", 3)])
def test_tasks_grow_with_the_files(spark, tiny, monkeypatch, name, deals):
    monkeypatch.setattr(batches, "SHARE", 1000)
    plan = plan_of(QUERIES[name](spark, tiny))
    sizes = re.findall(r"hashpartitioning\(image_id#\d+, (\d+)\)", plan)
    assert len(set(sizes)) == (2 if name == "multiline_images" else 1) and int(sizes[-1]) > 100 and "REPARTITION_BY_NUM" in plan
    assert len(sizes) >= deals and not re.search(r"hashpartitioning\(image_id#\d+, line", plan)


@pytest.mark.parametrize("name, deals", [("multiline_images", 3), ("detected_lines", 3)])
def test_shares_hold_below_the_sessions_partitions(spark, tiny, monkeypatch, name, deals):
    monkeypatch.setattr(batches, "SHARE", 1000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5000")
    try:
        plan = plan_of(QUERIES[name](spark, tiny))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    dealt = re.findall(r"hashpartitioning\(image_id#\d+, (\d+)\), REPARTITION_BY_NUM", plan)
    assert len(dealt) == deals and len(set(dealt)) == 1 and batches.FEW < int(dealt[0]) < 5000


def test_lines_in_order_are_dealt_by_shares(spark, tiny, monkeypatch):
    want = QUERIES["detected_lines"](spark, tiny)
    assert re.search(r"rangepartitioning\(.*, 4\), ENSURE_REQUIREMENTS", plan_of(want))
    monkeypatch.setattr(batches, "SHARE", 2000)
    got = QUERIES["detected_lines"](spark, tiny)
    dealt = re.findall(r"rangepartitioning\(.*, (\d+)\), (\w+)", plan_of(got))
    assert len(dealt) == 1 and int(dealt[0][0]) > batches.FEW and dealt[0][1] == "REPARTITION_BY_NUM"
    kept = got.withColumn("part", F.spark_partition_id()).collect()
    parts = [r.part for r in kept]
    assert parts == sorted(parts) and len(set(parts)) > batches.FEW and max(map(parts.count, parts)) < len(parts) / 4
    places = [(r.image_id, r.y, r.x) for r in kept]
    assert places == sorted(places) and same(got, want)
