"""Models as plug-ins, their choice, training loops, settings and what a round leaves."""

import json

import numpy as np
import pytest

from quarrymill.functions import pixels
from quarrymill.operators import annotations as ann, models, rounds
from quarrymill.sources import files
from quarrymill.streaming import progress

from .test_files import png


@pytest.fixture
def pictures(spark, tmp_path):
    rng = np.random.default_rng(2)
    for k in range(5):
        (tmp_path / f"p{k}.png").write_bytes(png(rng.integers(0, 255, (40, 60))))
    (tmp_path / "bad.png").write_bytes(b"no")
    return files.pixels(spark, str(tmp_path)).withColumnRenamed("origin", "path")


class Means:
    def __call__(self, batch):
        assert batch.shape[1:] == (3, models.SIDE, models.SIDE) and len(batch) <= 2
        return np.stack([batch.mean(axis=(2, 3))[:, 0], np.ones(len(batch)), batch.std(axis=(1, 2, 3))], axis=1)


class Corner:
    def __call__(self, picture, prompt):
        assert picture.shape == (40, 60, 3)
        return np.array([[1, 0, 0, 30, 20, 0.9], [0, 0, 0, 6, 4, 0.8], [3, 1, 1, 5, 5, 0.4]]) if prompt == "cat" else np.zeros((0, 6))


def test_embedded(spark, pictures):
    models.register("means", Means, 3)
    got = models.embedded(pictures, "means", batch=2).collect()
    assert len(got) == 6 and sum(r.v is None for r in got) == 1 and all(np.isclose(np.linalg.norm(r.v), 1) for r in got if r.v)
    with pytest.raises(ValueError):
        models.backend("vgg")
    with pytest.raises(ValueError):
        models.register("other", Means)
    models.register("resnet50", Means)
    assert models.backend("resnet50")[1] == 2048
    x = models.prepared(np.full((10, 10, 3), 255))
    assert np.allclose(x[:, 0, 0], [(1 - m) / d for m, d in zip(models.MEANS, models.DEVIATIONS)], atol=1e-5)


def test_detected(pictures):
    got = models.detected(pictures, Corner, prompt="cat").collect()
    assert len(got) == 10 and {(r.ord, r.cls_id, r.cx, r.cy, r.w, r.h, r.conf) for r in got} == {(0, 0, 0.25, 0.25, 0.5, 0.5, 0.9), (1, 0, 0.05, 0.05, 0.1, 0.1, 0.8)}
    assert not models.detected(pictures, Corner).count()


def test_anchors_to_boxes(spark):
    raw = spark.createDataFrame([("a", 0, 320.0, 320.0, 100.0, 50.0, [0.1, 0.9], 1280, 720), ("a", 1, 322.0, 320.0, 100.0, 50.0, [0.2, 0.8], 1280, 720), ("a", 2, 100.0, 300.0, 20.0, 20.0, [0.2, 0.1], 1280, 720)], "img string, ord int, x double, y double, w double, h double, scores array<double>, width int, height int")
    kept = ann.suppressed(ann.best_class(models.anchors(raw))).collect()
    assert [(r.ord, r.cls_id, r.x1, r.y1, r.x2, r.y2) for r in kept] == [(0, 1, 540.0, 310.0, 740.0, 410.0)]


def test_training_loop(spark, tmp_path):
    told, rates = [], []

    def epoch(k, rate):
        rates.append(rate)
        if len(rates) > 8:
            raise RuntimeError("out of memory")
        return 1.0 / (k + 1), k / 10

    out = str(tmp_path / "messages")
    assert models.trained(epoch, 4, models.Messages(out, "a"), callback=lambda *x: told.append(x)) == "success"
    assert told == [(k, 4, "train") for k in (1, 2, 3, 4)] and np.allclose(rates, [0.005] * 3 + [0.0005])
    assert models.trained(epoch, 9, models.Messages(out, "b"), stop=lambda: len(rates) == 6) == "stopped"
    assert models.trained(epoch, 9, models.Messages(out, "c")) == "error"
    query = progress.messages(spark, out).writeStream.format("memory").queryName("told").start()
    progress.stopped(query, drain=True)
    rows = spark.table("told")
    assert not query.isActive
    steps = {r.run: (r.epoch, r.steps) for r in progress.latest(rows.where("status = 'step'")).collect()}
    assert {k: v[1] for k, v in steps.items()} == {"a": 4, "b": 2, "c": 2}
    assert sorted(r.status for r in rows.where("status != 'step'").collect()) == sorted(["start"] * 3 + ["success", "stopped", "error"])


def test_start_weights():
    start = rounds.start_weights
    have = {"best_m_r2_m0900.pt", "best_ssd300.pth"}
    assert start("/x/own.pt", "recursive", "b.pt", have, custom=True) == "/x/own.pt"
    assert start("best_m_r2_m0900.pt", "recursive", "b.pt", have) == "best_m_r2_m0900.pt"
    assert start("best_m_r3_m0950.pt", "recursive", "b.pt", have) == "b.pt" and start("m", "recursive", None, have) == "m.pt"
    assert start("ssd300", "recursive", "b.pt", have) == "best_ssd300.pth" and start("faster1", "recursive", None, have) == "faster1.pth"
    assert start("best_m_r2_m0900.pt", "transfer", "b.pt", have) == "m.pt" and start("ssd300", "transfer", None, have) == "ssd300.pth"
    assert start("m", "scratch", None, have) == "m.yaml" and start("rtdetr-l", "scratch", None, have) == "rtdetr-l.pt"
    with pytest.raises(ValueError):
        start("m", "other", None, have)


def test_closed_round(spark):
    schema = "round int, model string, mAP double, epochs int, seq int"
    table = spark.createDataFrame([(1, "a", 0.8, 30, 1), (2, "b", 0.9, 30, 2), (3, "c", 0.7, 30, 3)], schema)
    new = lambda score: spark.createDataFrame([(3, "d", score, 40, 4)], schema)
    kept, record, deploy = rounds.closed_round(table, new(0.85))
    assert sorted((r["round"], r.model) for r in kept.collect()) == [(1, "a"), (2, "b"), (3, "d")]
    assert [tuple(r) for r in record.collect()] == [(3, "d", 0.85, 40)] and deploy.first().model == "b"
    assert rounds.closed_round(table, new(0.9))[2].first().model == "d"


def test_best_model_steps(spark):
    h = spark.createDataFrame([("x", 1, 0.9), ("y", 2, 0.9), ("z", 3, 0.99)], "model string, round int, mAP double")
    there = spark.createDataFrame([("x", 5), ("y", 6), ("w", 4)], "model string, modified int")
    last = spark.createDataFrame([("w",)], "model string")
    pick = lambda *a: [tuple(r) for r in rounds.best_model(*a).collect()]
    assert pick(h, there, last) == [("x", "history")]
    assert pick(h.limit(0), there, last) == [("w", "last round")] and pick(h.limit(0), there, last.limit(0)) == [("y", "newest")]
    assert pick(h, there.limit(0), last) == []


def test_settings_and_records(spark, tmp_path):
    at = f"file://{tmp_path}"
    assert tuple(files.settings(spark, f"{at}/settings.json").first()) == (True, False, 0) and not files.last_round(spark, f"{at}/none.json").count() and not files.history(spark, f"{at}/none.json").count()
    files.save_json(spark.createDataFrame([(False, True, 7)], files.SETTINGS), f"{at}/settings.json")
    assert tuple(files.settings(spark, f"{at}/settings.json").first()) == (False, True, 7)
    (tmp_path / "odd.json").write_text('{"ai_assist": false}')
    assert tuple(files.settings(spark, f"{at}/odd.json").first()) == (False, False, 0)
    files.save_json(spark.createDataFrame([(2, "m", 0.5, 30)], files.LAST_ROUND), f"{at}/last.json")
    assert tuple(files.last_round(spark, f"{at}/last.json").first()) == (2, "m", 0.5, 30)
    files.save_json(spark.createDataFrame([(1, "a"), (2, "b")], "round int, model string"), f"{at}/history.json", many=True)
    assert [(r["round"], r.model) for r in files.history(spark, f"{at}/history.json").collect()] == [(1, "a"), (2, "b")] and len(json.loads((tmp_path / "history.json").read_text())) == 2
    with pytest.raises(ValueError):
        files.save_json(spark.range(2), f"{at}/x.json")


def test_project_files(spark, tmp_path):
    root = tmp_path / "set"
    (root / "images").mkdir(parents=True)
    for n in ("b.PNG", "a.jpg", "c.txt", "d.jpeg"):
        (root / "images" / n).write_bytes(b"x")
    folder = files.images_folder(spark, f"file://{root}")
    assert folder.endswith("/set/images") and files.labels_folder(folder).endswith("/set/labels") and files.labels_folder("/x/pics") == "/x/pics"
    assert [(r.ord, r.stem) for r in files.images(spark, folder).orderBy("ord").collect()] == [(0, "a"), (1, "b"), (2, "d")]
    (tmp_path / "two" / "train" / "images").mkdir(parents=True)
    assert files.images_folder(spark, str(tmp_path / "two")).endswith("/train/images") and files.images_folder(spark, str(tmp_path / "none")).endswith("/none")
    (tmp_path / "w").mkdir()
    for n in ("best_a.pt", "best_b.pth", "best.pt", "last.pt", "best_c.txt"):
        (tmp_path / "w" / n).write_bytes(b"x")
    assert sorted(r.model for r in files.weights(spark, str(tmp_path / "w")).collect()) == ["best_a.pt", "best_b.pth"]
    (tmp_path / "list.txt").write_text("a.jpg\n\n b.jpg \n")
    assert [r.path for r in files.train_list(spark, str(tmp_path / "list.txt")).collect()] == ["a.jpg", "b.jpg"]
    (tmp_path / "results.csv").write_text("epoch, metrics/mAP50(B), metrics/mAP50-95(B)\n0,0.1,0.05\n10,0.6,0.44446\n9,0.5,0.4\n")
    assert files.last_result(spark, str(tmp_path / "results.csv")).first()[0] == 0.4445
    (tmp_path / "map.json").write_text(json.dumps({"backend": "m", "k": 1, "rep_target": 1, "created": "x", "clusters": [{"cluster_id": 0, "color": "c", "representative": "r", "members": ["r", "s"], "status": "t"}]}))
    assert files.clusters(spark, str(tmp_path / "map.json")).first().members == ["r", "s"]


def test_writers_clamp_and_name(spark):
    boxes = spark.createDataFrame([("a", 0, 0, 0.95, 0.5, 0.2, 0.1, 100, 50, False), ("a", 1, 1, 0.5, 0.5, 0.0, 0.5, 100, 50, False), ("a", 2, 1, 0.5, 0.5, 0.5, 0.5, 100, 50, True), ("b", 0, 1, 0.5, 0.5, 0.009, 0.5, 100, 50, False)], "img string, ord int, cls_id int, cx double, cy double, w double, h double, width int, height int, is_ai boolean")
    assert [tuple(r) for r in files.yolo_lines(boxes).collect()] == [("a", "0 0.925000 0.500000 0.150000 0.100000\n")]
    schema = "img string, file_name string, width int, height int, depth int, name string, cls_id int, xmin double, ymin double, xmax double, ymax double, ord int"
    docs = files.voc_documents(spark.createDataFrame([("a", "a.png", 10, 5, 1, None, 7, 1.9, 1.0, 2.0, 2.0, 0), ("b", "b.png", 10, 5, 3, None, None, None, None, None, None, 0)], schema), "pics")
    body = {r.img: r.body for r in docs.collect()}
    assert all(x in body["a"] for x in ("<folder>pics</folder>", "<depth>1</depth>", "<name>7</name>", "<xmin>1</xmin>")) and "<object>" not in body["b"]
    maps = rounds.cluster_map(spark.createDataFrame([(0, 1)], "cluster int, id long"), spark.createDataFrame([(0, 1), (11, 9)], "cluster int, medoid long"))
    assert sorted((r.cluster_id, r.colour, r.members) for r in maps.collect()) == [(0, 0, [1]), (11, 1, [9])]


def test_imported(spark, tmp_path):
    classes = spark.createDataFrame([(0, "person"), (5, "dog")], "cls_id int, name string")
    doc = {"categories": [{"id": 1, "name": "zebra"}, {"id": 2, "name": "dog"}, {"id": 3, "name": "ant"}], "images": [{"id": 1, "file_name": "x/a.png", "width": 10, "height": 10}, {"id": 2, "file_name": "b.png", "width": 10, "height": 10}], "annotations": [{"id": 5, "image_id": 1, "category_id": 3, "bbox": [1, 1, 2, 2]}, {"id": 4, "image_id": 1, "category_id": 2, "bbox": [0, 0, 9, 9]}, {"id": 6, "image_id": 2, "category_id": 99, "bbox": [0, 0, 1, 1]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    _, cats, found = files.coco(spark, str(tmp_path / "c.json"))
    out, every, _ = files.imported(found, classes, names=cats.selectExpr("name", "category_id as ord"))
    assert {(r.cls_id, r.name) for r in every.collect()} == {(0, "person"), (5, "dog"), (6, "zebra"), (7, "ant")}
    assert [tuple(r) for r in out.collect()] == [("a", "5 0.450000 0.450000 0.900000 0.900000\n7 0.200000 0.200000 0.200000 0.200000\n")]
    (tmp_path / "v").mkdir()
    obj = lambda n: f"<object><name>{n}</name><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>3</xmax><ymax>3</ymax></bndbox></object>"
    (tmp_path / "v" / "a.xml").write_text(f"<annotation><filename>a.png</filename><size><width>10</width><height>10</height><depth>3</depth></size>{''.join(map(obj, ('cat', '10_yaozhed', 'd', '?', 'dog')))}</annotation>")
    (tmp_path / "v" / "b.xml").write_text(f"<annotation><filename>b.png</filename>{obj('cat')}</annotation>")
    (tmp_path / "v" / "c.xml").write_text(f"<annotation><filename>c.png</filename><size><width>10</width><height>10</height><depth>3</depth></size>{obj('d')}</annotation>")
    out, every, bad = files.imported(files.voc(spark, str(tmp_path / "v")), classes, key="img", whitelist=True)
    assert {r.name for r in bad.collect()} == {"d", "?"} and {(r.cls_id, r.name) for r in every.collect()} >= {(6, "cat"), (7, "10_yaozhed")}
    assert [(r.img, r.body.count("\n")) for r in out.collect()] == [("a", 3)]


def test_training_set(spark, pictures):
    imgs = pictures.withColumn("img", files.stem(pictures["path"]))
    boxes = spark.createDataFrame([("p0", 1, 0, 0.5, 0.5, 2.0, 0.5), ("p0", 0, 2, 0.1, 0.1, 0.1, 0.1), ("p1", 0, 0, 1.5, 0.5, 0.1, 0.1), ("bad", 0, 0, 0.5, 0.5, 0.1, 0.1)], "img string, ord int, cls_id int, cx double, cy double, w double, h double")
    got = {r.img: r for r in files.training_set(imgs, files.training_boxes(boxes, imgs.select("img", "width", "height"))).collect()}
    assert sorted(got) == ["p0", "p1", "p2", "p3", "p4"] and got["p1"].targets == [] and len(got["p2"].data) == 40 * 60
    assert [(t.label, round(t.x1, 9), round(t.x2, 9)) for t in got["p0"].targets] == [(3, 3.0, 9.0), (1, 0.0, 60.0)]


def test_coco_words(spark):
    assert len(ann.COCO_NAMES) == len(set(ann.COCO_NAMES)) == 80 and set(ann.COCO_SYNONYMS.values()) <= set(ann.COCO_NAMES)
    names = spark.createDataFrame([("Man",), (" sofa ",), ("",), ("  ",), ("kraken",), ("dog",)], "name string")
    one = ann.overlap(names, ann.coco_classes(spark), ann.coco_synonyms(spark)).first()
    assert (one.matched, one.total, one.ratio, one.recommended) == (3, 4, 0.75, True)


def test_labels_of_orientations():
    x = np.arange(16).reshape(4, 4)
    assert len(pixels.LABELS) == len(pixels.oriented(x)) == 8 and len({y.tobytes() for y in map(np.ascontiguousarray, pixels.oriented(x))}) == 8
