"""Readers and writers of annotation sets and of what a project keeps beside them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.boxes import coco_to_yolo, corners_to_centre, corners_to_yolo, yolo_to_corners, yolo_to_rect
from ..functions.pixels import exif_orientation, upright
from ..functions.values import basename, stem
from ..operators.annotations import accepted, class_union
from ..operators.groups import numbered, written
from . import cocofile, filesets

EXTENSIONS = ("jpg", "png", "jpeg")
COCO = "categories array<struct<id:long,name:string>>, images array<struct<id:long,file_name:string,width:double,height:double>>, annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,area:double,iscrowd:int>>"
VOC = "filename string, size struct<width:double,height:double,depth:int>, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
HISTORY = "round int, model string, mAP double, epochs int, time string, images int, duration_min double, mAP50_95 double"
CLUSTERS = "backend string, k int, rep_target int, created string, clusters array<struct<cluster_id:int,color:string,representative:string,members:array<string>,status:string>>"
LAST_ROUND = "round int, model string, mAP double, epochs int"
SETTINGS = "ai_assist boolean, compare_mode boolean, train_round int"
PROGRESS = "run string, status string, epoch int, total int, map50 double, loss double, ts timestamp"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def images_folder(spark: SparkSession, root: str) -> str:
    """Where a dataset's images are: its folder images, else train/images, else the dataset's own."""
    root = root.rstrip("/")
    return next((f for f in (f"{root}/images", f"{root}/train/images") if exists(spark, f)), root)


def labels_folder(images: str) -> str:
    """Where the label files of a folder of images are: beside a folder images in labels, else in the same."""
    images = images.rstrip("/")
    return images[: -len("images")] + "labels" if images.rsplit("/", 1)[-1] == "images" else images


def images(spark: SparkSession, folder: str, extensions=EXTENSIONS, content: bool = False, recursive: bool = True, unreadable: bool = False) -> DataFrame:
    """path, uri (encoded, as the image source's origin), stem, time and length of the image files of a folder, and ord (their place by
    path, from 0) or, if asked for, the bytes: files with their bytes are not moved to be numbered. Files that can't be read are
    left out (unreadable: raise instead)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreCorruptFiles", str(not unreadable).lower())
    files = reader.load(folder).where(F.lower("path").rlike(r"\.(" + "|".join(extensions) + ")$"))
    columns = ["path", F.col("_metadata.file_path").alias("uri"), stem(F.col("path")).alias("stem"), "modificationTime", "length"]
    return files.select(*columns, "content") if content else numbered(files.select(*columns), "ord", "path")


def weights(spark: SparkSession, folder: str) -> DataFrame:
    """model (file name), modified of a folder's trained weights (best_*.pt, best_*.pth)."""
    files = spark.read.format("binaryFile").load(folder).select(basename(F.col("path")).alias("model"), F.col("modificationTime").alias("modified"))
    return files.where(F.col("model").rlike(r"^best_.*\.pth?$"))


def backups_to_drop(files: DataFrame, most: int = 3, ending: str = ".pt") -> DataFrame:
    """model of the weights (model, modified) that a clean-up deletes: the last epoch's, and all but the newest `most` of those that are no
    best ones."""
    own = files.where(F.col("model").endswith(ending))
    backups = own.where((F.col("model") != f"best{ending}") & ~F.col("model").startswith("best_") & (F.col("model") != f"last{ending}"))
    kept = backups.orderBy(F.desc("modified"), "model").limit(most)
    return backups.join(kept.select("model"), "model", "left_anti").select("model").union(own.where(F.col("model") == f"last{ending}").select("model"))


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images, BGR, by content whatever their endings; unreadable ones have height -1."""
    return spark.read.format("image").option("recursiveFileLookup", "true").load(folder).select("image.*")


def plain_uri(uri: Column) -> Column:
    """A file's address with one slash after its scheme, as all of Spark's sources can be compared."""
    return F.regexp_replace(uri, "^([A-Za-z][A-Za-z0-9+.-]*:)/+", "$1/")


def upright_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """pixels(), turned and mirrored as the files' EXIF orientation asks, wherever in a file it stands; those without one, or that can't
    be read, as they are."""
    heads = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("_metadata.file_path").alias("uri"), "content")
    decoded = pixels(spark, folder)
    told = heads.select(plain_uri(F.col("uri")).alias("__uri"), F.pandas_udf(lambda s: s.map(lambda b: exif_orientation(bytes(b))).astype("int32"), "int")("content").alias("__o")).where("__o > 1")

    def turn(parts):
        import numpy as np

        for pdf in parts:
            for k, o in zip(pdf.index, pdf.pop("__o")):
                if o == o and o and pdf.at[k, "height"] > 0:
                    h, w, c = (int(pdf.at[k, x]) for x in ("height", "width", "nChannels"))
                    x = upright(np.frombuffer(pdf.at[k, "data"], np.uint8).reshape(h, w, c), int(o))
                    pdf.at[k, "data"], pdf.at[k, "height"], pdf.at[k, "width"] = x.tobytes(), x.shape[0], x.shape[1]
            yield pdf

    return decoded.withColumn("__uri", plain_uri(F.col("origin"))).join(told, "__uri", "left").drop("__uri").mapInPandas(turn, decoded.schema)


def label_lines(spark: SparkSession, folder: str) -> DataFrame:
    """img, ord, line of label files."""
    return spark.read.option("wholetext", "true").text(folder).select(stem(F.col("_metadata.file_path")).alias("img"), F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line"))


def parsed_lines(lines: DataFrame) -> DataFrame:
    """lines (line, and more columns) as cls_id, cx, cy, w, h; those with fewer than five numbers, or others, are left out."""
    # try_cast of a decimal string to int is null where the class is no whole number
    parts = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    more = [c for c in lines.columns if c != "line"]
    out = lines.select(*more, parts.alias("p")).where(F.size("p") >= 5)
    names = ("cls_id", "cx", "cy", "w", "h")
    out = out.select(*more, *[F.col("p")[k].try_cast("int" if k == 0 else "double").alias(n) for k, n in enumerate(names)])
    return out.where(" and ".join(f"{n} is not null" for n in names))


def yolo(spark: SparkSession, folder: str) -> DataFrame:
    """img, ord, cls_id, cx, cy, w, h of label files."""
    return parsed_lines(label_lines(spark, folder))


def drawn(boxes: DataFrame, sizes: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boxes as an editor draws them (left, top, width, height in pixels, not clamped), and the classes with a placeholder class_<n> for
    each id up to the highest that has no name. sizes: img, width, height; classes: cls_id, name."""
    cols = yolo_to_rect(*[F.col(c) for c in ("cx", "cy", "w", "h")], F.col("width"), F.col("height"))
    out = boxes.join(sizes, "img").select("img", "ord", "cls_id", *[c.alias(n) for c, n in zip(cols, ("x", "y", "width", "height"))])
    top = boxes.agg(F.max("cls_id").alias("top"))
    made = top.select(F.explode(F.sequence(F.lit(0), F.coalesce("top", F.lit(0)))).alias("cls_id"), "top").where("top >= 0 and cls_id <= top").select(F.col("cls_id").cast("int").alias("cls_id"))
    spare = made.join(classes.select("cls_id"), "cls_id", "left_anti").select("cls_id", F.format_string("class_%d", "cls_id").alias("name"))
    return out, classes.select(F.col("cls_id").cast("int").alias("cls_id"), "name").unionByName(spare)


def training_boxes(boxes: DataFrame, sizes: DataFrame) -> DataFrame:
    """img, ord, label, x1, y1, x2, y2 as a detector is trained on them: corners in pixels, clamped; boxes that are empty then go; labels
    begin with 1 (0 is the background)."""
    x1, y1, x2, y2 = yolo_to_corners(*[F.col(c) for c in ("cx", "cy", "w", "h")], F.col("width"), F.col("height"))
    out = boxes.join(sizes, "img").select("img", "ord", (F.col("cls_id") + 1).alias("label"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return out.where("x2 > x1 and y2 > y1")


def training_set(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """img, width, height, nChannels, data and targets (an array of label, x1, y1, x2, y2 by ord; empty without a box) of the images that
    can be read: one row an image, as a training loop takes them from mapInPandas. images: img and the image source's columns;
    boxes: as training_boxes() gives them."""
    readable = images.where("height > 0")
    own = boxes.groupBy("img").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct("label", "x1", "y1", "x2", "y2").alias("t")))), lambda s: s["t"]).alias("targets"))
    kind = own.schema["targets"].dataType
    return readable.join(own, "img", "left").select("img", "width", "height", "nChannels", "data", F.coalesce("targets", F.array().cast(kind)).alias("targets"))


def class_counts(lines: DataFrame) -> DataFrame:
    """cls_id, n of label lines: only the class of a line needs to be a number."""
    first = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    return lines.select(first.alias("p")).where(F.size("p") >= 5).select(F.col("p")[0].try_cast("int").alias("cls_id")).where("cls_id is not null").groupBy("cls_id").agg(F.count("*").alias("n"))


def imported(annotations: DataFrame, classes: DataFrame, key: str = "file_name", whitelist: bool = False, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """label files (img, body) of imported annotations (key, name, ord, cx, cy, w, h), the classes with the new ones (those of the dataset
    keep their ids; new names follow in the order of `names` (name, ord), such as a COCO file's categories, else of their first
    annotation), and the names that the whitelist rejects. Images
    without an annotation that stays get no file."""
    good, bad = accepted(annotations) if whitelist else (annotations, annotations.select("name").limit(0))
    every = class_union(classes, good.select("name", "ord") if names is None else names)
    boxes = good.join(every, "name").select(stem(F.col(key)).alias("img"), "ord", "cls_id", "cx", "cy", "w", "h")
    return yolo_lines(boxes), every, bad.distinct()


def coco(spark: SparkSession, path: str, step: int = cocofile.RANGE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, categories, annotations (in YOLO form, those of unknown images or categories left out) of a COCO file, which is read once,
    in byte ranges."""
    found = written(cocofile.elements(spark, path, step))
    kind = {f.name: f.dataType.elementType for f in T._parse_datatype_string(COCO).fields}
    of = lambda name: found.where(F.col("key") == name).select(F.from_json("body", kind[name]).alias("x")).select("x.*")
    imgs = of("images").select(F.col("id").alias("image_id"), basename(F.col("file_name")).alias("file_name"), "width", "height")
    cats = of("categories").select(F.col("id").alias("category_id"), "name")
    ann = of("annotations").join(imgs, "image_id").join(cats, "category_id")
    x, y, w, h = (F.col("bbox")[k] for k in range(4))
    cols = coco_to_yolo(x, y, w, h, F.col("width"), F.col("height"))
    return imgs, cats, ann.select("file_name", "name", F.col("id").alias("ord"), *[c.alias(n) for c, n in zip(cols, ("cx", "cy", "w", "h"))])


def save_coco(imgs: DataFrame, boxes: DataFrame, classes: DataFrame, path: str) -> None:
    """Writes coco_tables() as one document of any size."""
    i, a, c = coco_tables(imgs, boxes, classes)
    cocofile.save({"images": i, "annotations": a, "categories": c}, path)


def voc(spark: SparkSession, folder: str) -> DataFrame:
    """img, ord (within a file), name, cx, cy, w, h of Pascal VOC files with a size; names are not checked here, but by imported()."""
    docs = spark.read.format("xml").option("rowTag", "annotation").schema(VOC).load(folder).where("size.width > 0 and size.height > 0")
    own = docs.select(stem(F.col("filename")).alias("img"), "size", F.posexplode("object").alias("ord", "o"))
    cols = corners_to_yolo(*[F.col(f"o.bndbox.{c}") for c in ("xmin", "ymin", "xmax", "ymax")], F.col("size.width"), F.col("size.height"))
    return own.select("img", "ord", F.col("o.name").alias("name"), *[c.alias(n) for c, n in zip(cols, ("cx", "cy", "w", "h"))])


def class_list(text: str) -> list[str]:
    """Class names of a data.yaml, whose `names` is a list or a map; ["object"] without one."""
    import re

    block = re.search(r"^names:[ \t]*(.*(?:\n(?:[ \t]+.*|- .*))*)", text, re.M)
    body = block[1].strip() if block else ""
    if body.startswith("["):
        found = [x.strip().strip("'\"") for x in body.strip("[]").split(",") if x.strip()]
    elif body.startswith("{"):
        found = [v.strip().strip("'\"") for _, v in sorted((int(k), v) for k, v in (x.split(":", 1) for x in body.strip("{}").split(",")))]
    else:
        lines = [x.strip() for x in body.split("\n") if x.strip()]
        listed = [x[2:].strip().strip("'\"") for x in lines if x.startswith("- ")]
        found = listed or [v.strip().strip("'\"") for _, v in sorted((int(k), v) for k, v in (x.split(":", 1) for x in lines if ":" in x))]
    return found or ["object"]


def data_yaml(root: str, names: list[str], train: str) -> str:
    return "\n".join([f"path: {root}", f"train: {train}", f"val: {train}", f"nc: {len(names)}", "names:", *[f"  {k}: {n}" for k, n in enumerate(names)]]) + "\n"


def history(spark: SparkSession, path: str) -> DataFrame:
    """The training history; empty where there is no file."""
    return spark.read.schema(HISTORY).option("multiLine", "true").json(path) if exists(spark, path) else spark.createDataFrame([], HISTORY)


def last_round(spark: SparkSession, path: str) -> DataFrame:
    """round, model, mAP, epochs of the last round; no row where there is no file."""
    return spark.read.schema(LAST_ROUND).option("multiLine", "true").json(path) if exists(spark, path) else spark.createDataFrame([], LAST_ROUND)


def settings(spark: SparkSession, path: str) -> DataFrame:
    """One row: ai_assist (true by default), compare_mode (false), train_round (0)."""
    found = spark.read.schema(SETTINGS).option("multiLine", "true").json(path) if exists(spark, path) else spark.createDataFrame([], SETTINGS)
    defaults = [F.coalesce(F.max(c), F.lit(v)).alias(c) for c, v in (("ai_assist", True), ("compare_mode", False), ("train_round", 0))]
    return found.agg(*defaults)


def save_json(rows: DataFrame, path: str, many: bool = False) -> None:
    """Writes few rows (a round's record, settings, a history) as one JSON document: an object, or (many) a list of objects. At most
    100,000 rows, which is checked."""
    found = [r.j for r in rows.select(F.to_json(F.struct(*rows.columns)).alias("j")).limit(100_001).collect()]
    if len(found) > 100_000 or (not many and len(found) != 1):
        raise ValueError("one row makes an object, up to 100,000 a list")
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    disk, temp = where.getFileSystem(spark._jsc.hadoopConfiguration()), where.suffix(f".{uuid.uuid4().hex}.new")
    out = disk.create(temp, True)
    out.write(bytearray(("[" + ",\n".join(found) + "]" if many else found[0]).encode()))
    out.close()
    # readers see the old document or the new one; where the file system renames over nothing only, there is none in between
    if not disk.rename(temp, where):
        disk.delete(where, False)
        disk.rename(temp, where)


def clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLUSTERS).option("multiLine", "true").json(path).select("backend", "k", "rep_target", "created", F.explode("clusters").alias("c")).select("backend", "k", "rep_target", "created", "c.*")


def train_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path != ''")


def last_result(spark: SparkSession, path: str, contains: str = "mAP50-95") -> DataFrame:
    """The last row's value of the column whose header contains `contains`, rounded to four places: mAP50_95."""
    raw = spark.read.option("header", "true").option("ignoreLeadingWhiteSpace", "true").csv(path)
    name = next((c for c in raw.columns if contains in c), None)
    epoch = next((c for c in raw.columns if c.strip() == "epoch"), raw.columns[0])
    if name is None:
        return spark.createDataFrame([], "mAP50_95 double")
    return raw.select(F.max_by(F.col(f"`{name}`").cast("double"), F.col(f"`{epoch}`").cast("double")).alias("v")).select(F.round("v", 4).alias("mAP50_95"))


def yolo_lines(boxes: DataFrame) -> DataFrame:
    """img, body: the label file of each image, of boxes that a person has confirmed (is_ai, where there is such a column, is false).
    Boxes that carry their image's width and height are clamped to it, and those of less than a pixel in either direction go."""
    kept = boxes.where(~F.col("is_ai")) if "is_ai" in boxes.columns else boxes
    cells = [F.col(c).cast("double") for c in ("cx", "cy", "w", "h")]
    if {"width", "height"} <= set(boxes.columns):
        size = [F.col("width").cast("double"), F.col("height").cast("double")]
        corners = yolo_to_corners(*cells, *size)
        kept = kept.withColumns(dict(zip(("__x1", "__y1", "__x2", "__y2"), corners))).where("__x2 - __x1 >= 1 and __y2 - __y1 >= 1")
        x1, y1, x2, y2 = (F.col(c) for c in ("__x1", "__y1", "__x2", "__y2"))
        cells = corners_to_centre(x1, y1, x2, y2, *size)
    line = F.format_string("%d %.6f %.6f %.6f %.6f", F.col("cls_id").cast("int"), *cells)
    rows = kept.groupBy("img").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("l"))
    return rows.select("img", F.concat(F.array_join(F.transform("l", lambda s: s["line"]), "\n"), F.lit("\n")).alias("body"))


def voc_documents(boxes: DataFrame, folder: str = "images") -> DataFrame:
    """img, body: one XML document for each image (file_name, width, height, and depth where there is such a column, else 3) with its
    boxes (name, corners, ord; cls_id, where there is such a column, names a box without a name). An image without boxes has a row
    without corners."""
    name = F.coalesce(F.col("name"), F.col("cls_id").cast("string")) if "cls_id" in boxes.columns else F.col("name")
    obj = F.struct(name.alias("name"), F.lit("Unspecified").alias("pose"), F.lit(0).alias("truncated"), F.lit(0).alias("difficult"), F.struct(*[F.col(c).cast("int").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]).alias("bndbox"))
    depth = F.col("depth") if "depth" in boxes.columns else F.lit(3)
    rows = boxes.withColumn("depth", depth.cast("int")).groupBy("img", "file_name", "width", "height", "depth").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("xmin").isNotNull(), F.struct("ord", obj.alias("o"))))), lambda s: s["o"]).alias("object"))
    size = F.struct(F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "depth")
    return rows.select("img", F.to_xml(F.struct(F.lit(folder).alias("folder"), F.col("file_name").alias("filename"), size.alias("size"), "object"), {"rowTag": "annotation"}).alias("body"))


def coco_tables(imgs: DataFrame, boxes: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations, categories with COCO's ids from 1, numbered in ranges. imgs: ord, file_name, width, height; boxes: file_name,
    ord, cls_id, x, y, w, h."""
    i = numbered(imgs, "__n", "ord").select((F.col("__n") + 1).alias("id"), "file_name", "width", "height")
    a = boxes.withColumnRenamed("ord", "box_ord").join(i.select(F.col("id").alias("image_id"), "file_name"), "file_name")
    a = numbered(a, "__n", "image_id", "box_ord")
    a = a.select((F.col("__n") + 1).alias("id"), "image_id", (F.col("cls_id") + 1).alias("category_id"), F.array("x", "y", "w", "h").alias("bbox"), (F.col("w") * F.col("h")).alias("area"), F.lit(0).alias("iscrowd"), F.array().cast("array<double>").alias("segmentation"))
    return i, a, classes.select((F.col("cls_id") + 1).alias("id"), "name")


def coco_document(imgs: DataFrame, boxes: DataFrame, classes: DataFrame, most: int = 1_000_000) -> DataFrame:
    """One row `body`: a COCO document, which holds `most` annotations and images at most (checked); larger sets stay coco_tables(), which
    any number of tasks can write."""
    tables = coco_tables(imgs, boxes, classes)
    if any(t.limit(most + 1).count() > most for t in tables):
        raise ValueError(f"more than {most} rows for one document: write coco_tables()")
    one = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    i, a, c = (one(t, n) for t, n in zip(tables, ("images", "annotations", "categories")))
    return i.join(a).join(c).select(F.to_json(F.struct("images", "annotations", "categories")).alias("body"))


def save_files(rows: DataFrame, folder: str, key: str = "img", ending: str = ".txt", whole: bool = False) -> None:
    """Writes each row's body to its own file, by the file set's commit: all files appear once every task is done, and none before.
    Other files of the folder stay; whole: the new files take the place of all."""
    filesets.registered(rows.sparkSession)
    own = rows.select(F.col(key).cast("string").alias("name"), "body")
    own.write.format("file_set").mode("overwrite" if whole else "append").option("path", folder).option("ending", ending).save()
