"""Functions, readers and writers on small literals."""

import json

import pytest
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import corpus, decode, layout, metrics
from vellum.sources import readers, writers


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def boxes(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "image_id int, box_id int, x int, y int, w int, h int, confidence double")


@pytest.mark.parametrize("ref, hyp, want", [("", "", 0.0), ("", "a", 1.0), ("abc", "abd", 1 / 3), ("ab", "a😀b", 0.5)])
def test_character_error_rate(spark, ref, hyp, want):
    assert one(spark, metrics.cer(F.lit(ref), F.lit(hyp))) == pytest.approx(want)


def test_text_functions(spark):
    assert one(spark, T.nfc(F.lit("éa"))) == "éa" and one(spark, T.nfc(F.lit("abc"))) == "abc"
    assert one(spark, T.strip(F.lit("  a b  \n"))) == "a b"
    assert one(spark, T.has_khmer(F.lit("aក"))) and not one(spark, T.has_khmer(F.lit("abc")))
    assert one(spark, T.slug(F.lit("Noto Sans.v2.ttf"))) == "Noto_Sans_v2"
    assert [one(spark, G.band(F.lit(x))) for x in (0.9, 0.900001, 0.7)] == ["medium", "high", "low"]
    assert one(spark, T.max_steps(F.lit(10), F.lit(160))) == 23 and one(spark, T.max_steps(F.lit(0), F.lit(160))) == 170


def test_tokens_of_any_plane(spark):
    df = spark.createDataFrame([("ab😀",), ("ក é",)], "text string")
    v = corpus.vocabulary(df)
    ids = [r.ids for r in corpus.tokenise(df.union(spark.createDataFrame([("z😀a",), ("",), (None,)], "text string")), v).collect()]
    number = {r.char: r.id for r in v.collect()}
    assert ids[0] == [1, *(number[c] + 3 for c in "ab😀"), 2] and ids[2] == [1, 3, number["😀"] + 3, number["a"] + 3, 2]
    assert ids[3] == [1, 2] and ids[4] is None


def test_suppression_and_merging(spark):
    b = boxes(spark, [(0, 0, 100, 10, 0.8), (0, 0, 70, 10, 0.6), (300, 0, 10, 10, 0.1)])
    assert sorted(r.box_id for r in layout.suppress(b, 0.5).collect()) == [0, 2]
    m = layout.merge_vertical(boxes(spark, [(0, 0, 9, 10, 1.0), (0, 1, 9, 10, 0.0), (0, 2, 9, 10, 1.0)])).collect()
    assert len(m) == 1 and m[0].confidence == 0.75 and (m[0].y, m[0].h) == (0, 12)


def test_word_gaps(spark):
    xs, x = [], 0
    for gap in [0, 2, 2, 2, 2, 15, 2, 2, 2, 2]:
        x += gap
        xs.append(x)
        x += 10
    got = [r.word for r in layout.words(layout.group_lines(boxes(spark, [(x, 0, 10, 10, 1.0) for x in xs]))).orderBy("x").collect()]
    assert got == [0] * 5 + [1] * 5


def test_document_lines(spark):
    rows = [(1, n + 1, 0, y, 10, 10, t, 1.0, None) for n, (y, t) in enumerate([(0, "a"), (7, "b"), (20, "c")])]
    r = spark.createDataFrame(rows, "image_id int, line_number int, x int, y int, w int, h int, text string, confidence double, error string")
    assert layout.document_text(r).first().text == "a b\nc"


def test_collapse(spark):
    logits = [[1.0 if k == i else 0.0 for k in range(4)] for i in [2, 2, 0, 2, 3, 3]]
    f = spark.createDataFrame([(1, t, v) for t, v in enumerate(logits)], "image_id int, t int, logits array<double>")
    r = decode.ctc_collapse(f).first()
    assert list(r.ids) == [0, 0, 1] and r.length == 3


def test_hierarchy(spark):
    b = boxes(spark, [(0, 0, 10, 10, 1.0), (12, 0, 10, 10, 1.0), (80, 0, 10, 10, 1.0), (0, 14, 90, 10, 1.0), (0, 300, 90, 10, 1.0)])
    got = [(r.block, [(x.line, [list(w.box_ids) for w in x.words]) for x in r.lines]) for r in layout.hierarchy(b, 1000, 1000).orderBy("block").collect()]
    assert got == [(0, [(0, [[0, 1], [2]]), (1, [[3]])]), (1, [(2, [[4]])])]
    assert layout.hierarchy(b.limit(0), 10, 10).count() == 0


def test_detect_lines(spark):
    b = boxes(spark, [(10, 10, 20, 12, 0.9), (34, 11, 20, 12, 0.7), (10, 10, 20, 12, 0.2), (10, 90, 20, 12, 0.1), (0, 400, 900, 12, 1.0), (50, 300, 1, 12, 1.0)])
    got = [(r.x, r.y, r.w, r.h, round(r.confidence, 6)) for r in layout.detect_lines(b, 1000, 800).collect()]
    assert got == [(8, 8, 48, 17, 0.8)]


def test_readers_and_writers(spark, tmp_path):
    at = str(tmp_path)
    (tmp_path / "train" / "images").mkdir(parents=True)
    (tmp_path / "train" / "labels.txt").write_text("a.png\tone\ttwo\n\nno tab\nb.png\tthree \n", encoding="utf-8")
    (tmp_path / "train" / "images" / "a.png").write_bytes(b"x")
    got = readers.labels(spark, f"{at}/train/labels.txt")
    assert [(r.image, r.text) for r in got.collect()] == [("a.png", "one"), ("b.png", "three")]
    assert readers.labels(spark, f"{at}/train/labels.txt", keep_tabs=True).first().text == "one\ttwo"
    assert [r.image for r in readers.existing(got, readers.listing(spark, f"{at}/train", "*.png"), ["images", "train"]).collect()] == ["a.png"]
    assert readers.text_lines(spark, f"{at}/train/labels.txt").count() == 3
    assert readers.first_existing(spark, [f"{at}/none", f"{at}/train"]) == f"{at}/train" and readers.validation(spark, at) is None
    assert readers.settings({"a": 1, "b": 2}, {"b": 3}, {"a": None, "b": 4}) == {"a": 1, "b": 4}
    v = corpus.vocabulary(spark.createDataFrame([("ba",)], "text string"))
    assert json.loads(writers.vocabulary_json(v).first().value) == {"<unk>": 0, "a": 1, "b": 2}
    writers.write_text(writers.label_lines(spark.createDataFrame([(7, "x")], "row int, text string")), f"{at}/out")
    assert spark.read.text(f"{at}/out").first().value == "000007.png\tx"


def test_quad_corners(spark):
    p = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(10, 9), (1, 8), (9, 0), (0, 1)]))
    assert [(q.x, q.y) for q in one(spark, G.corner_order(p))] == [(0, 1), (9, 0), (10, 9), (1, 8)]
    assert one(spark, G.short_side(G.corner_order(p))) == pytest.approx(50**0.5)


def test_settings_map(spark):
    assert one(spark, T.language_paths(F.lit("en:/a, km:/b"))) == {"en": "/a", "km": "/b"}
