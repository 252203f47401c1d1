"""Commits of file sets and COCO documents cut anywhere."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarrymill.sources import cocofile, files, filesets


def held(folder):
    return {p.name: p.read_text() for p in folder.iterdir()} if folder.exists() else {}


def beside(folder):
    return sorted(p.name for p in folder.parent.iterdir() if p.name.startswith("."))


def rows(spark, n, tag):
    return spark.range(n).repartition(4).select(F.concat(F.lit("i"), "id").alias("img"), F.concat(F.lit(tag), "id", F.lit("\n")).alias("body"))


@pytest.mark.parametrize("whole", [False, True])
def test_file_sets_appear_whole(spark, tmp_path, whole):
    folder = tmp_path / "labels"
    files.save_files(rows(spark, 30, "a"), f"file://{folder}", whole=whole)
    assert held(folder) == {f"i{k}.txt": f"a{k}\n" for k in range(30)}
    files.save_files(rows(spark, 10, "b"), str(folder), whole=whole)
    assert held(folder) == ({} if whole else {f"i{k}.txt": f"a{k}\n" for k in range(10, 30)}) | {f"i{k}.txt": f"b{k}\n" for k in range(10)}
    before = held(folder)
    # a task that dies after its fellows have written, and a name that can't be one
    broken = rows(spark, 50, "c").withColumn("body", F.when(F.col("img") == "i7", F.raise_error(F.lit("killed"))).otherwise(F.col("body")))
    for bad in (broken, rows(spark, 50, "c").withColumn("img", F.concat(F.lit("x/"), "img"))):
        with pytest.raises(Exception):
            files.save_files(bad, str(folder), whole=whole)
        assert held(folder) == before and beside(folder) == []


def test_broken_off_commits_are_ended(spark, tmp_path, monkeypatch):
    folder = tmp_path / "labels"
    files.save_files(rows(spark, 5, "a"), str(folder))
    disk, path = filesets.filesystem(str(folder))
    # in mode append: the journal stands, one file has moved
    staged = tmp_path / ".labels.staged-t"
    staged.mkdir()
    (staged / "i1.txt").write_text("new")
    (tmp_path / ".labels.journal-t").write_text(json.dumps({"staged": str(staged)}))
    assert filesets.recover(str(folder)) == 1 and held(folder)["i1.txt"] == "new" and beside(folder) == [] and len(held(folder)) == 5
    # in mode overwrite: between the renames
    staged.mkdir()
    (staged / "z.txt").write_text("z")
    folder.rename(tmp_path / ".labels.old-t")
    assert filesets.recover(str(folder)) == 1 and held(folder) == {"z.txt": "z"} and beside(folder) == [] and filesets.recover(str(folder)) == 0


def odd_document():
    rng = random.Random(2)
    text = lambda: "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ":", ",", "a", "é", "漢", "\n", '\\"']) for _ in range(rng.randint(0, 9)))
    imgs = [{"id": k, "file_name": f"x/{k}.png", "width": 100, "height": 50, "note": text(), "meta": {"deep": [{"id": 5, "t": [text()]}]}} for k in range(12)]
    anns = [{"id": k, "image_id": rng.randint(0, 14), "category_id": rng.randint(1, 4), "bbox": [1.5 * k, 2, 3, 4], "segmentation": [[1, 2], [3]], "note": text()} for k in range(40)]
    cats = [{"id": k, "name": f"c{k}", "keypoints": [text()]} for k in (1, 2, 3)]
    return {"info": {"about": text(), "list": [{"id": 1}]}, "licenses": [{"id": 1, "name": text()}], "images": imgs, "categories": cats, "empty": [], "numbers": [1, 2], "annotations": anns}


@pytest.mark.parametrize("indent", [None, 1])
def test_documents_cut_anywhere(spark, tmp_path, indent):
    doc = odd_document()
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=False), encoding="utf-8")
    want = sorted((k, json.dumps(x, sort_keys=True)) for k in ("licenses", "images", "categories", "annotations") for x in doc[k])
    for step in (37, 101, 1000, 1 << 20):
        got = cocofile.elements(spark, str(tmp_path / "c.json"), step).collect()
        assert sorted((r.key, json.dumps(json.loads(r.body), sort_keys=True)) for r in got) == want
        assert len({r.at for r in got}) == len(got)
    one = [sorted(map(tuple, t.collect())) for t in files.coco(spark, str(tmp_path / "c.json"))]
    assert one == [sorted(map(tuple, t.collect())) for t in files.coco(spark, str(tmp_path / "c.json"), 64)]
    assert len(one[2]) == sum(a["image_id"] < 12 and a["category_id"] < 4 for a in doc["annotations"])
    (tmp_path / "cut.json").write_text(json.dumps(doc)[:-20])
    with pytest.raises(ValueError):
        cocofile.elements(spark, str(tmp_path / "cut.json"), 64)


def test_large_documents_are_joined(spark, tmp_path):
    imgs = spark.range(3000).select(F.col("id").cast("int").alias("ord"), F.concat("id", F.lit(".png")).alias("file_name"), F.lit(100.0).alias("width"), F.lit(50.0).alias("height"))
    boxes = spark.range(9000).select(F.concat((F.col("id") % 3000), F.lit(".png")).alias("file_name"), F.col("id").cast("int").alias("ord"), (F.col("id") % 3).cast("int").alias("cls_id"), *[F.lit(float(k)).alias(c) for k, c in enumerate("xywh", 1)])
    classes = spark.createDataFrame([(0, 'a"\n{'), (1, "b"), (2, "c")], "cls_id int, name string")
    files.save_coco(imgs, boxes, classes, str(tmp_path / "out.json"))
    doc = json.loads((tmp_path / "out.json").read_text())
    assert [x["id"] for x in doc["images"]] == [*range(1, 3001)] and [x["id"] for x in doc["annotations"]] == [*range(1, 9001)]
    assert [x["name"] for x in doc["categories"]] == ['a"\n{', "b", "c"] and doc["annotations"][0]["bbox"] == [1, 2, 3, 4]
    assert [p.name for p in tmp_path.iterdir()] == ["out.json"]
    assert files.coco(spark, str(tmp_path / "out.json"), 10_000)[2].count() == 9000
    files.save_coco(imgs.limit(0), boxes.limit(0), classes, str(tmp_path / "out.json"))
    assert json.loads((tmp_path / "out.json").read_text())["images"] == []
