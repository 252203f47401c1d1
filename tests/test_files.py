"""Readers, writers, pictures, rounds and streams on generated fixtures."""

import json
import struct
import zlib

import numpy as np

from quarrymill.functions import pixels
from quarrymill.operators import pictures, rounds
from quarrymill.sources import files
from quarrymill.streaming import progress


def png(x):
    h, w = x.shape
    raw = b"".join(b"\0" + x[i].astype(np.uint8).tobytes() for i in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_yolo(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 .5 .5 .1 .1\n1 .5 .5 .1\nx 0 0 1 1\n1.0 .5 .5 .1 .1\n2 .5  .5 .1 .1 7\n3 .9 .5 .4 .1\n")
    got = files.yolo(spark, str(tmp_path)).orderBy("ord")
    assert [r.cls_id for r in got.collect()] == [0, 2, 3]
    out = tmp_path / "out"
    files.save_files(files.yolo_lines(got), f"file://{out}")
    assert (out / "a.txt").read_text().splitlines()[0] == "0 0.500000 0.500000 0.100000 0.100000"


def test_coco_and_voc(spark, tmp_path):
    doc = {"categories": [{"id": 7, "name": "cat"}], "images": [{"id": 1, "file_name": "x/a.png", "width": 100, "height": 50}], "annotations": [{"id": 1, "image_id": 1, "category_id": 7, "bbox": [10, 10, 20, 10]}, {"id": 2, "image_id": 9, "category_id": 7, "bbox": [0, 0, 1, 1]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    _, _, ann = files.coco(spark, str(tmp_path / "c.json"))
    assert [(r.file_name, r.name, r.cx, r.cy) for r in ann.collect()] == [("a.png", "cat", 0.2, 0.3)]
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.xml").write_text("<annotation><filename>a.png</filename><size><width>100</width><height>50</height><depth>3</depth></size><object><name>cat</name><bndbox><xmin>10</xmin><ymin>10</ymin><xmax>30</xmax><ymax>20</ymax></bndbox></object></annotation>")
    assert [(r.img, r.name, r.cx, r.cy) for r in files.voc(spark, str(tmp_path / "v")).collect()] == [("a", "cat", 0.2, 0.3)]
    imgs = spark.createDataFrame([(1, "a.png", 100.0, 50.0)], "ord int, file_name string, width double, height double")
    boxes = spark.createDataFrame([("a.png", 1, 0, 10.0, 10.0, 20.0, 10.0)], "file_name string, ord int, cls_id int, x double, y double, w double, h double")
    body = json.loads(files.coco_document(imgs, boxes, spark.createDataFrame([(0, "cat")], "cls_id int, name string")).first().body)
    assert body["annotations"][0]["bbox"] == [10, 10, 20, 10] and body["annotations"][0]["area"] == 200
    one = spark.createDataFrame([("a", "a.png", 100, 50, "cat", 10.7, 10.0, 30.0, 20.0, 0)], "img string, file_name string, width int, height int, name string, xmin double, ymin double, xmax double, ymax double, ord int")
    assert "<xmin>10</xmin>" in files.voc_documents(one).first().body


def test_class_lists():
    assert files.class_list("names: [a, 'b']\nnc: 2") == ["a", "b"]
    assert files.class_list("nc: 2\nnames:\n  0: a\n  1: b\n") == ["a", "b"]
    assert files.class_list("names:\n- a\n- b\n") == ["a", "b"] and files.class_list("nc: 1") == ["object"]
    assert files.class_list(files.data_yaml("r", ["x", "y"], "t")) == ["x", "y"]


def test_pictures(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = np.kron(rng.integers(0, 255, (16, 16)), np.ones((8, 8)))
    (tmp_path / "a.jpg").write_bytes(png(x))
    (tmp_path / "b.png").write_bytes(b"no")
    got = files.pixels(spark, str(tmp_path))
    assert sorted(r.height for r in got.collect()) == [-1, 128]
    from pyspark.sql import functions as F

    d = got.select(pixels.described(F.struct(*got.columns)).alias("d")).where("d.hash is not null").first().d
    assert len(d.hash) == 64 and len(d.gray) == 128 * 128
    assert pixels.difference(x, np.rot90(x)) == 0 and not pixels.same_picture(x, 255 - x)
    shifted = np.roll(x, 2, axis=1)
    assert pixels.shifted_difference(x, shifted) < pixels.difference(x, shifted)
    assert pixels.sharpness(np.full((9, 9), 7.0)) == 0 and len(pixels.wide_hash(x)[0]) == 256


def test_exif(spark, tmp_path):
    """A JPEG made by the JVM, with an EXIF block put in, for each orientation and byte order."""
    x = np.zeros((16, 32), np.uint8)
    x[:8, :16] = 255  # the bright quarter is at the top left
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(32, 16, jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY)
    for r in range(8):
        for c in range(16):
            picture.setRGB(c, r, 0xFFFFFF)
    jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(f"{tmp_path}/plain.jpg"))
    plain = (tmp_path / "plain.jpg").read_bytes()
    corners = {1: (0, 0), 2: (0, 1), 3: (1, 1), 4: (1, 0), 5: (0, 0), 6: (0, 1), 7: (1, 1), 8: (1, 0)}
    for o in range(1, 9):
        for mark, end in ((b"II", "<"), (b"MM", ">")):
            tiff = mark + struct.pack(end + "HIH", 42, 8, 2) + struct.pack(end + "HHIHH", 0x010F, 3, 1, 1, 0) + struct.pack(end + "HHIHH", 0x0112, 3, 1, o, 0) + bytes(4)
            block = b"Exif\0\0" + tiff
            data = plain[:2] + b"\xff\xe1" + struct.pack(">H", len(block) + 2) + block + plain[2:]
            assert pixels.exif_orientation(data) == o
            other = b"\xff\xe2" + struct.pack(">H", 60_002) + bytes(60_000)
            data = data[:2] + 2 * other + data[2:]  # far behind the file's beginning
            assert pixels.exif_orientation(data) == o
        (tmp_path / f"o{o}.jpg").write_bytes(data)
    assert pixels.exif_orientation(plain) == pixels.exif_orientation(b"") == pixels.exif_orientation(b"\x89PNG") == 1
    (tmp_path / "bad.jpg").write_bytes(b"no")
    got = {r.origin.rsplit("/", 1)[1][:-4]: r for r in files.upright_pixels(spark, str(tmp_path)).collect()}
    assert got["bad"].height == -1 and len(got) == 10
    for o, (down, right) in corners.items():
        r = got[f"o{o}"]
        y = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)[..., 0]
        assert (r.height, r.width) == ((16, 32) if o < 5 else (32, 16))
        half = y[: r.height // 2] if not down else y[r.height // 2 :]
        assert (half[:, : r.width // 2] if not right else half[:, r.width // 2 :]).mean() > 200 and y.mean() < 80


def test_scan(spark, tmp_path):
    rng = np.random.default_rng(4)
    picture = lambda high: np.kron(rng.integers(0, high, (16, 16)), np.ones((8, 8)))
    a, flat, fine, moved, tall = picture(255), picture(150), picture(150) + 40, picture(150), np.kron(rng.integers(0, 255, (32, 20)), np.ones((9, 9)))
    waves = np.indices((128, 128)).sum(axis=0) % 2 * 60 - 30
    made = {"a x": a, "b_rot": np.rot90(a), "c_flip": np.fliplr(a), "d_copy": a, "e": flat, "f": flat + 60, "g": fine, "h": fine + waves, "k": moved, "l": np.roll(moved, 2, axis=1), "m": tall, "n": np.rot90(np.fliplr(tall)), "o": picture(255)}
    for name, x in made.items():
        (tmp_path / f"{name}.png").write_bytes(png(x))
    (tmp_path / "junk.png").write_bytes(b"no")

    def found(**how):
        out = {}
        for r in pictures.scan(spark, str(tmp_path), **how).collect():
            out.setdefault((r.layer, r.group_id), []).append((r.pos, r.path.rsplit("/", 1)[1].replace("%20", " ")[:-4], r.reason, r.is_keeper, r.distance))
        return {(k[0], tuple(m[1] for m in sorted(v))): [m[2:] for m in sorted(v)] for k, v in out.items()}

    got = found()
    assert set(got) == {("L1", ("a x", "d_copy")), ("L3", ("a x", "b_rot", "c_flip")), ("L3", ("m", "n"))}
    assert got["L3", ("a x", "b_rot", "c_flip")] == [("representative", True, 0.0), ("hamming=0 (original↔rotated_270)", False, 0.0), ("hamming=0 (original↔flip_horizontal)", False, 0.0)]
    # the hashes alone take the bright and the fine-grained ones for copies
    assert {("L2", ("e", "f")), ("L2", ("g", "h"))} <= set(found(pixel=None))
    assert ("L2", ("k", "l")) in found(most=90) and ("L2", ("k", "l")) not in found(most=90, reach=0)


def test_rounds(spark):
    s, did = rounds.step(rounds.RoundState(training=True), "quota_met")
    assert did == "notice" and rounds.step(s, "quota_met")[1] == "nothing" and rounds.step(s, "training_succeeded") == (rounds.RoundState(), "setup")
    h = spark.createDataFrame([(1, 0.5, 1), (2, 0.6, 2)], "round int, mAP double, seq int")
    out = rounds.upserted(h, spark.createDataFrame([(2, 0.7, 3)], h.schema))
    assert sorted((r["round"], r.mAP) for r in out.collect()) == [(1, 0.5), (2, 0.7)]
    m = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (1, 4)], "cluster int, id long")
    c = rounds.cluster_map(m, spark.createDataFrame([(0, 1), (1, 3)], "cluster int, medoid long"))
    left = rounds.pruned(c, spark.createDataFrame([(3,), (2,)], "id long"))
    assert [(r.cluster_id, r.members) for r in left.collect()] == [(0, [1])]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"run": "a", "status": "step", "epoch": k, "total": 3, "map50": k / 10, "loss": 1.0 / (k + 1), "ts": f"2024-01-01T00:0{k}:00"}) for k in range(3)))
    q = progress.latest(progress.messages(spark, str(src))).writeStream.outputMode("complete").format("memory").queryName("latest_runs").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.run, r.epoch, r.steps) for r in spark.table("latest_runs").collect()] == [("a", 2, 3)]
