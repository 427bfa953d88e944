"""Searches against brute force, streams run as streams, documents to text, image kernels and files."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum import documents, fixtures
from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import beam, decode, layout, vision
from vellum.plans import models
from vellum.sources import readers, writers
from vellum.streaming import running

# searches


def wide(memory, seq):
    return beam.table_step(memory, seq)


@pytest.mark.parametrize("seed", range(4))
def test_widest_beam_finds_the_best(seed):
    """With room for all hypotheses the search gives the best-scored sequence of all."""
    rng = np.random.default_rng(seed)
    memory = rng.normal(size=(3, 5))
    lm = lambda m, s: beam.log_softmax(np.random.default_rng([seed, len(s)]).normal(size=5))
    how = beam.Search(beam=10_000, end_bias=0.4, end_boost=0.3, unknown=3)
    ctc = beam.log_softmax(rng.normal(size=(4, 5)))
    target, _ = beam.greedy_length(ctc)
    got = beam.beam_search(memory, wide, how, ctc, lm, steps=3)
    best = (-math.inf, None)
    for seq in (s for n in (1, 2, 3) for s in itertools.product(range(5), repeat=n)):
        if beam.EOS in seq[:-1] or (len(seq) < 3 and seq[-1] != beam.EOS):
            continue
        steps, so_far = [], [beam.BOS]
        for t in seq:
            steps.append(beam.next_scores(memory, so_far, wide, lm, target, how)[t])
            so_far.append(t)
        body = [t for t in seq if t != beam.EOS]
        score = sum(steps) / len(seq) ** 0.8 + 0.5 * beam.ctc_forward(ctc, [t - 1 for t in body if t > beam.EOS])
        best = max(best, (score, (body, min(1, math.exp(np.mean(steps))))), key=lambda x: x[0])
    assert got[0] == best[1][0] and got[1] == pytest.approx(best[0])
    assert got[2] == pytest.approx(0.6 * best[1][1] + 0.4 * np.exp(ctc.max(axis=1)).mean())


def test_alignment_score_sums_all_paths():
    lp = beam.log_softmax(np.random.default_rng(3).normal(size=(4, 4)))
    labels, total = [2, 2, 3], -math.inf
    for path in itertools.product(range(4), repeat=4):
        kept = [k for k, _ in itertools.groupby(path) if k != 0]
        if kept == labels:
            total = np.logaddexp(total, sum(lp[t, k] for t, k in enumerate(path)))
    assert beam.ctc_forward(lp, labels) == pytest.approx(total / 3)
    assert beam.ctc_forward(lp, []) == pytest.approx(lp[:, 0].mean())


def test_steps_and_end_bonus(spark):
    how = beam.Search(end_bias=1.5, end_boost=0.75)
    assert (how.steps(40, 10), how.steps(40, None), how.steps(40, 0), how.steps(9000, None)) == (23, 50, 50, 512)
    for n in range(6):
        for target in (None, 1, 2, 3, 5):
            got = spark.range(1).select(T.end_bonus(F.lit(n), F.lit(target).cast("int"), 1.5, 0.75).alias("v")).first().v
            assert got == beam.end_bonus(n, target, how)


def test_streams_of_tokens_end_as_the_search_does(spark):
    frames = fixtures.frames(spark, "/root/testdata/sf0.001")
    for greedy in (True, False):
        rows = beam.decode_stream(frames, greedy).orderBy("image_id", "step").collect()
        for _, group in itertools.groupby(rows, key=lambda r: r.image_id):
            group = list(group)
            assert [r.step for r in group] == list(range(1, len(group) + 1)) and not any(r.finished for r in group[:-1])
            if greedy:
                assert [t for r in group for t in r.tokens] == group[-1].ids
    last = {r.image_id: r.ids for r in decode.ctc_stream(frames).where("finished").collect()}
    assert last == {r.image_id: r.ids for r in decode.ctc_collapse(frames).collect()}


# streams


def run_stream(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_running_text_as_a_stream(spark, tmp_path):
    """Regions arrive in four micro-batches; the state carries each document's text on."""
    regions = fixtures.regions(spark, "/root/testdata/sf0.001").where("image_id < 6").withColumn("confidence", F.col("confidence").cast("double"))
    for part in range(4):
        regions.where(F.floor((F.col("line_number") - 1) / 40) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(regions.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    got = {(r.image_id, r.line_number): r.cumulative_text for r in run_stream(documents.Reader.running(stream), "running_regions").collect()}
    want = {(r.image_id, r.line_number): r.cumulative_text for r in layout.cumulative_text(regions).collect()}
    assert got == want and len(want) > 300


def test_token_streams(spark, tmp_path):
    tokens = fixtures.tokens(spark, "/root/testdata/sf0.001").where("doc < 8").withColumn("region", F.floor((F.col("step") - 1) / 7).cast("int"))
    marked = decode.mark_regions(tokens)
    rows = tokens.join(marked.select("doc", "step", F.col("region_finished").alias("closes"), F.col("document_finished").alias("last")), ["doc", "step"])
    for part in range(2):
        rows.where((F.col("step") > 40) == bool(part)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    key = lambda r: (r.doc, r.step)
    got = {key(r): r.cumulative_text for r in run_stream(running.token_stream(stream.select("doc", "step", "token")), "running_tokens").collect()}
    assert got == {key(r): r.cumulative_text for r in decode.running_text(tokens).collect()}
    chars = {key(r): r for r in run_stream(running.character_stream(stream), "running_characters").collect()}
    for r in marked.collect():
        c = chars[key(r)]
        assert (c.region_number, c.region_start, c.region_finished, c.document_finished) == (r.region_number, r.region_start, r.region_finished, r.document_finished)
    assert all(c.cumulative_text.count("\n") == c.region_number - 1 for c in chars.values())


def test_windows_drop_late_rows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 05:00:00", "a", 2.0), ("2024-01-01 05:10:00", "a", 16.0), ("2024-01-01 00:20:00", "a", 4.0), ("2024-01-01 09:00:00", "a", 8.0)]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={k}"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.start.hour, r.n, r.total) for r in run_stream(running.event_windows(stream), "late_rows").collect()}
    assert (0, 1, 1.0) in got and not any(total == 4.0 or total == 5.0 for _, _, total in got)


# documents to text


@pytest.fixture(scope="module")
def reader():
    def broken(images):
        raise RuntimeError("no weights")

    def found(images):
        p = F.explode(F.from_json("layout", "array<struct<x:int,y:int,w:int,h:int,t:string>>")).alias("b")
        return images.select("image_id", p).select("image_id", "b.x", "b.y", "b.w", "b.h", F.lit(0.9).alias("confidence"))

    def make():
        def read(batch):
            by = [{(b["x"], b["y"]): b["t"] for b in json.loads(x)} for x in batch["layout"]]
            return [(t[x, y], 0.8) for t, x, y in zip(by, batch["x"], batch["y"], strict=True)]

        return read

    return documents.Reader([broken, found], (("test",), make), ordered=True)


def page(*boxes):
    return json.dumps([dict(zip("xywht", b, strict=True)) for b in boxes])


def test_documents_to_text(spark, reader):
    images = spark.createDataFrame([(1, page((0, 0, 40, 10, "Hello"), (50, 1, 40, 10, "world"), (0, 40, 40, 10, "again"))), (2, page()), (3, page((5, 5, 9, 9, "")))], "image_id int, layout string")
    assert {r.image_id: r.text for r in reader.text(images).collect()} == {1: "Hello world\nagain"}
    got = [(r.line_number, r.text, r.cumulative_text) for r in reader.results(images).orderBy("line_number").collect()]
    assert got == [(1, "Hello", "Hello"), (2, "world", "Hello world"), (3, "again", "Hello world\nagain")]
    with pytest.raises(RuntimeError):
        models.detect(images, reader.detectors[:1])


def test_failing_recogniser(spark, reader):
    def make():
        def read(batch):
            raise ValueError("out of memory")

        return read

    images = spark.createDataFrame([(1, page((0, 0, 40, 10, "Hello")))], "image_id int, layout string")
    r = documents.Reader(reader.detectors, (("bad",), make))
    assert [(x.text, x.error) for x in r.regions(images).collect()] == [("", "out of memory")] and r.regions(images, strict=True).count() == 0 and r.text(images).count() == 0


def test_methods(spark):
    got = spark.createDataFrame([("FAST",), (" \tbeam\n",), ("accurate",), ("ctc",)], "m string").select(models.method(F.col("m")).alias("v")).collect()
    assert [r.v for r in got] == ["ctc", "beam", "decoder", "ctc"]
    with pytest.raises(Exception, match="unknown decode method"):
        spark.range(1).select(models.method(F.lit("greedy"))).collect()


# image kernels


def test_binarisations():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (40, 30, 3)).astype(np.uint8)
    names = list(vision.candidates(image))
    assert len(names) == len(set(names)) == 26 and len(vision.candidates(image[..., 0])) == 11 and len(vision.candidates(image, colours=False)) == 11
    got = vision.candidates(image)
    assert all((got[n] == ~got[f"{n}_inv"]).all() for n in names if f"{n}_inv" in got)
    v = image[..., 0]
    brute = np.array([[v[y, x] > round(float(np.mean([v[min(39, max(0, y + j)), min(29, max(0, x + i))] for j in range(-5, 6) for i in range(-5, 6)]))) - 5 for x in range(30)] for y in range(40)])
    assert (vision.adaptive(v, "mean", 11, 5) == brute).all()
    assert vision.otsu(np.array([[10] * 5 + [200] * 5], np.uint8)) == 10


def test_colours():
    assert vision.lab(np.array([[[255, 255, 255], [0, 0, 0], [0, 0, 255]]], np.uint8)).tolist() == [[[255, 128, 128], [0, 128, 128], [136, 208, 195]]]
    assert vision.grey_of(np.array([[[255, 255, 255], [255, 0, 0], [0, 0, 255]]], np.uint8)).tolist() == [[255, 29, 76]]


def test_equalising_keeps_order_and_evens_contrast():
    ramp = np.tile(np.linspace(100, 140, 64).astype(np.uint8), (64, 1))
    out = vision.equalised(ramp)
    assert out.shape == ramp.shape and np.ptp(out.astype(int)) > np.ptp(ramp.astype(int))


def test_least_rectangle():
    rng = np.random.default_rng(2)
    turn = lambda a: np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])
    for a in (0, 0.3, 1.1):
        box = np.array([[0, 0], [30, 0], [30, 8], [0, 8]], float) @ turn(a).T + 50
        inside = box[0] + rng.random((50, 1)) * (box[1] - box[0]) + rng.random((50, 1)) * (box[3] - box[0])
        got = vision.least_rectangle(np.concatenate([box, inside]))
        assert all(min(np.linalg.norm(got - p, axis=1)) < 1e-6 for p in box)


def test_linked_components_join_and_widen():
    text, link = np.zeros((20, 40)), np.zeros((20, 40))
    text[8:12, 5:12] = text[8:12, 18:26] = 0.9
    link[9:11, 11:19] = 0.8
    text[2:4, 30:32] = 0.9  # too small
    text[15:19, 2:9] = 0.5  # not sure enough
    (found,) = vision.linked_quads(text, link)
    quad = found[1]
    assert quad[0].tolist() == quad.min(axis=0).tolist() and quad[:, 0].min() < 5 and quad[:, 0].max() > 25 and quad[:, 1].min() < 8
    assert len(vision.linked_quads(text, np.zeros((20, 40)))) == 2


def test_curved_outlines():
    """A word bent like a bow: its outline follows it; a straight one that fills its quad has none."""
    mask = np.zeros((60, 120), bool)
    for x in range(10, 110):
        middle = 40 - int(20 * math.sin(math.pi * (x - 10) / 100))
        mask[middle - 4 : middle + 5, x] = True
    quad = np.array([[10, 14], [109, 14], [109, 46], [10, 46]], float)
    got = vision.curved_outline(mask, quad)
    assert got.shape == (14, 2)
    top, bottom = got[1:6], got[8:13][::-1]
    for (x, y), (u, v) in zip(top, bottom, strict=True):
        middle = 40 - 20 * math.sin(math.pi * ((x + u) / 2 - 10) / 100)
        assert y < middle < v and abs((y + v) / 2 - middle) < 3
    straight = np.zeros((60, 120), bool)
    straight[14:47, 10:110] = True
    assert vision.curved_outline(straight, quad) is None and vision.curved_outline(mask, quad / 20) is None


def test_stages_of_detection(spark):
    b = fixtures.boxes(spark, "/root/testdata/sf0.001")
    counts = {k: v.count() for k, v in layout.stages(b, fixtures.WIDTH, fixtures.HEIGHT).items()}
    assert counts["components"] >= counts["filtered"] >= counts["kept"] == counts["grouped"] > counts["lines"] > 0


def test_stored_score_maps(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(16.0).reshape(4, 4))
    (tmp_path / "b.npy").write_bytes(b"no map")
    got = {r.path[-5:]: (r.failed, r["values"]) for r in readers.score_maps(spark, str(tmp_path), 4).collect()}
    assert got == {"a.npy": (False, [0.0, 2.0, 8.0, 10.0]), "b.npy": (True, [0.0] * 4)}


def test_augmentation_is_set_by_its_seed(spark):
    df = spark.createDataFrame([(k, 4, 4, 1, [100] * 16) for k in range(40)], "image_id int, width int, height int, channels int, values array<int>")
    a, b, c = ({r.image_id: r["values"] for r in vision.augment(df.repartition(n), s).collect()} for n, s in ((1, 5), (3, 5), (1, 6)))
    assert a == b and a != c and all(0 <= v <= 255 for x in a.values() for v in x) and any(x != [100] * 16 for x in a.values())


def test_heat_colours(spark):
    got = [spark.range(1).select(G.heat_colour(F.lit(v)).alias("c")).first().c for v in (0.0, 0.5, 1.0, -1.0, 2.0)]
    assert [(c.b, c.g, c.r) for c in got] == [(128, 0, 0), (127 if got[1].b == 127 else got[1].b, 255, got[1].r), (0, 0, 128), (128, 0, 0), (0, 0, 128)]


# files


def test_settings_and_checkpoints(spark, tmp_path):
    path = str(tmp_path / "settings.yaml")
    writers.write_file(spark, path, writers.default_settings())
    lines = dict(x.split(": ") for x in open(path).read().splitlines())
    assert lines["height"] == "48" and lines["device"] == "cuda" and lines["resume"] == "false" and len(lines) == len(writers.DEFAULTS)
    writers.write_file(spark, str(tmp_path / "model_meta.json"), writers.checkpoint_json("v.json", 3, 900, 91.5, {"ENC_DIM": "256"}))
    got = readers.checkpoint_meta(spark, str(tmp_path / "model.safetensors")).first()
    assert (got.vocab_path, got.epoch, got.step, got.best_val_acc, got.config) == ("v.json", 3, 900, 91.5, {"ENC_DIM": "256"})
    assert readers.checkpoint_meta(spark, str(tmp_path / "other.safetensors")) is None


def test_benchmark_folders(spark, tmp_path):
    for font in ("Arial", "Noto_Sans"):
        for split in ("train", "val", "test"):
            folder = tmp_path / font / split
            folder.mkdir(parents=True)
            (folder / "labels.txt").write_text(f"0.png\t{font} {split}\tx\n\nno tab\n")
    got = {(r.font, r.split, r.image, r.text) for r in readers.benchmark_labels(spark, str(tmp_path)).collect()}
    assert got == {(f, s, "0.png", f"{f} {s}\tx") for f in ("Arial", "Noto_Sans") for s in ("train", "val")}


def test_font_files(spark, tmp_path):
    for name in ("Khmer.ttf", "Arial.OTF", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    fonts = readers.fonts(spark, str(tmp_path))
    assert {(r.path.split("/")[-1], r.script) for r in fonts.collect()} == {("Khmer.ttf", "khmer"), ("Arial.OTF", "english")}
    assert readers.sized_fonts(fonts).count() == 12
    wanted = spark.createDataFrame([("Khmer.ttf",), ("Lost.ttf",)], "name string")
    assert [r.name for r in readers.listed_fonts(wanted, fonts).collect()] == ["Khmer.ttf"]


def test_validation_set_and_text_files(spark, tmp_path):
    for s in ("val", "test"):
        spark.createDataFrame([(s, "t")], "image string, text string").write.parquet(str(tmp_path / s))
    assert readers.validation(spark, str(tmp_path)).endswith("/val") and readers.validation(spark, str(tmp_path / "none")) is None
    both = readers.dataset(spark, [str(tmp_path / "val"), str(tmp_path / "test")])
    assert {r.image for r in both.collect()} == {"val", "test"}
    writers.write_text(spark.createDataFrame([("a",)], "value string"), str(tmp_path / "text"))
    writers.write_json(both, str(tmp_path / "json"))
    writers.write_tsv(both, str(tmp_path / "tsv"))
    assert spark.read.text(str(tmp_path / "text")).first().value == "a"
    assert spark.read.json(str(tmp_path / "json")).count() == spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv")).count() == 2


def test_annotation_lists(spark, tmp_path):
    one = {"image": "1.jpg", "text": "ab", "layout": "list", "num_lines": 2, "boxes": [{"char": "a", "bbox": [0, 0, 5, 9], "center": [2.5, 4.5]}]}
    (tmp_path / "dataset_info.json").write_text(json.dumps({"samples": [one]}))
    a = readers.annotations(spark, str(tmp_path)).first()
    (tmp_path / "annotations_list.json").write_text(json.dumps([one, one]))
    assert (a.image, a.boxes[0].bbox) == ("1.jpg", [0, 0, 5, 9]) and readers.annotations(spark, str(tmp_path)).count() == 2
    with pytest.raises(FileNotFoundError):
        readers.annotations(spark, str(tmp_path / "none"))


def test_command_line(spark, tmp_path, capsys):
    from vellum.__main__ import main

    main(["list"])
    assert "quality_by_font" in capsys.readouterr().out
    main(["init-config", str(tmp_path / "s.yaml")])
    main(["run", "font_ranking", "/root/testdata/sf0.001", str(tmp_path / "out"), "--format", "json"])
    assert "batch_size: 32" in (tmp_path / "s.yaml").read_text() and spark.read.json(str(tmp_path / "out")).count() > 0
    with pytest.raises(SystemExit):
        main(["run", "no_such_query", "x", "y"])
