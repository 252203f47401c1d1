"""Boxes, classes and predictions: joins, remapping, suppression, statistics."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.boxes import iou
from ..functions.values import basename, class_name_ok, stem
from .groups import dropped, leaders, numbered, written


def class_union(old: DataFrame, new: DataFrame) -> DataFrame:
    """cls_id, name: old classes keep their ids, new names follow after the highest, in the order of their first place. old: cls_id,
    name; new: name, ord."""
    first = new.join(old.select("name"), "name", "left_anti").groupBy("name").agg(F.min("ord").alias("ord"))
    after = old.agg((F.coalesce(F.max("cls_id"), F.lit(-1)) + 1).cast("long").alias("after"))
    more = numbered(first, "place", "ord", "name").join(F.broadcast(after)).select((F.col("after") + F.col("place")).alias("cls_id"), "name")
    return old.select(F.col("cls_id").cast("long").alias("cls_id"), "name").unionByName(more)


def accepted(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose class name is accepted, and the distinct rejected names."""
    return names.where(class_name_ok(F.col("name"))), names.where(~class_name_ok(F.col("name"))).select("name").distinct()


def known_annotations(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations of known images and categories, with the columns of both."""
    return annotations.join(images, "image_id").join(categories, "category_id")


def remapped(boxes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Boxes with class ids by mapping (old_id, new_id); boxes of other classes go."""
    return boxes.join(mapping, boxes["cls_id"] == mapping["old_id"]).drop("old_id", "cls_id").withColumnRenamed("new_id", "cls_id")


def mapped_predictions(predictions: DataFrame, classes: DataFrame, model_names: DataFrame, coco: DataFrame | None = None) -> DataFrame:
    """cls_id of the dataset for each prediction: by the model's class name, else the raw id if the dataset has it (only without a
    COCO table), else 0; `matched` tells whether the name was found."""
    names = (coco if coco is not None else model_names).select(F.col("cls_id").alias("raw_id"), F.lower("name").alias("name"))
    own = classes.select(F.lower("name").alias("name"), F.col("cls_id").alias("by_name"))
    out = predictions.withColumnRenamed("cls_id", "raw_id").join(names, "raw_id", "left").join(own, "name", "left")
    if coco is not None:
        return out.withColumn("cls_id", F.coalesce("by_name", F.lit(0))).withColumn("matched", F.col("by_name").isNotNull()).drop("by_name")
    ids = classes.select(F.col("cls_id").alias("raw_id"), F.col("cls_id").alias("by_id"))
    return out.join(ids, "raw_id", "left").withColumn("cls_id", F.coalesce("by_name", "by_id", F.lit(0))).withColumn("matched", F.col("by_name").isNotNull()).drop("by_name", "by_id")


def known_names(names: DataFrame, vocabulary: DataFrame, synonyms: DataFrame) -> DataFrame:
    """name, standard of the names that, trimmed, in lower case and by synonym (name, standard), are in the vocabulary (name)."""
    own = names.select("name", F.lower(F.trim("name")).alias("key"))
    std = own.join(synonyms.select(F.col("name").alias("key"), F.col("standard").alias("other")), "key", "left").select("name", F.coalesce("other", "key").alias("standard"))
    return std.join(vocabulary.select(F.col("name").alias("standard")).distinct(), "standard", "left_semi").select("name", "standard")


def overlap(names: DataFrame, vocabulary: DataFrame, synonyms: DataFrame) -> DataFrame:
    """One row: matched, total, ratio, recommended (a match, and half of the names or more). Empty names don't count. synonyms: name,
    standard."""
    own = names.select(F.lower(F.trim("name")).alias("name")).where("name != ''")
    std = own.join(synonyms.select("name", "standard"), "name", "left").select(F.coalesce("standard", "name").alias("name"))
    hit = std.join(vocabulary.select("name", F.lit(1).alias("hit")), "name", "left")
    out = hit.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("matched"), F.count("*").alias("total"))
    return out.withColumn("ratio", F.when(F.col("total") > 0, F.col("matched") / F.col("total")).otherwise(0.0)).withColumn("recommended", (F.col("matched") >= 1) & (F.col("ratio") >= 0.5))


def overlapping(boxes: DataFrame, key: str, threshold: float) -> DataFrame:
    """a < b, the keys (unique within an image) of boxes (img, x1, y1, x2, y2, key) of one image whose IoU exceeds the threshold, which
    must be above 0. Boxes without area overlap nothing.

    Grids have cells of 2^g; a box lies in at most four cells of the grid just above its longer side, and of each coarser one. Sides of
    two boxes that overlap so much differ by less than a factor 1 / threshold, so a few grids are enough. A pair meets in the grid
    of its larger box, and is kept in the cell that holds the first corner of what both cover: once."""
    if threshold <= 0:
        raise ValueError("overlapping() needs a threshold above 0")
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    own = F.ceil(F.log2(side)).cast("int")
    rows = boxes.where("x2 > x1 and y2 > y1").select("img", "x1", "y1", "x2", "y2", key, own.alias("own"))
    rows = rows.withColumn("grid", F.explode(F.sequence(F.col("own"), F.col("own") + (math.ceil(-math.log2(threshold)) + 1 if threshold < 1 else 1))))
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("grid"))).cast("long")
    rows = rows.withColumn("cx", F.explode(F.sequence(cell("x1"), cell("x2")))).withColumn("cy", F.explode(F.sequence(cell("y1"), cell("y2"))))
    rows = written(rows)  # a crowded cell's join can be split
    a, b = rows.alias("a"), rows.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("img", "grid", "cx", "cy")]
    corners = lambda t: [F.col(f"{t}.{c}") for c in ("x1", "y1", "x2", "y2")]
    at = lambda c: F.floor(F.greatest(f"a.{c}", f"b.{c}") / F.pow(F.lit(2.0), F.col("a.grid"))).cast("long")
    once = (F.col("a.grid") == F.greatest("a.own", "b.own")) & (F.col("a.cx") == at("x1")) & (F.col("a.cy") == at("y1"))
    met = a.join(b, functools.reduce(operator.and_, same) & (F.col(f"a.{key}") < F.col(f"b.{key}"))).where(once)
    return met.where(iou(corners("a"), corners("b")) > threshold).select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"))


#: Boxes of an image up to which one task suppresses them; those of larger images are settled in rounds over all tasks.
IMAGE_BOXES = 10_000


def suppressed(predictions: DataFrame, confidence: float = 0.25, threshold: float = 0.45, most: int = IMAGE_BOXES) -> DataFrame:
    """Class-agnostic non-maximum suppression of predictions (img, x1, y1, x2, y2, conf, ord): those that stay. By falling conf (ties:
    ord) each kept box drops later ones of its image that overlap by more than the threshold. One pass over the boxes, dealt and
    sorted by image; images of more than `most` boxes are settled as leaders of a graph."""
    rows = predictions.where(F.col("conf") > confidence)
    large = written(rows.groupBy("img").agg(F.count("*").alias("n")).where(F.col("n") > most).select("img"))
    few = large.limit(1_000_001).count() <= 1_000_000
    names = rows.columns

    def keep(batches):
        import pyarrow as pa

        img, kept = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("img", "x1", "y1", "x2", "y2")]
            stays = []
            for i, a, b, c, d in zip(*cols):
                if i != img:
                    img, kept = i, []
                area = (c - a) * (d - b)
                ok = True
                for x1, y1, x2, y2, other in kept:
                    w, h = min(c, x2) - max(a, x1), min(d, y2) - max(b, y1)
                    if w > 0 and h > 0 and w * h > threshold * (area + other - w * h):
                        ok = False
                        break
                if ok:
                    kept.append((a, b, c, d, area))
                stays.append(ok)
            yield batch.filter(pa.array(stays, pa.bool_()))

    small = rows.join(F.broadcast(large) if few else large, "img", "left_anti").select(*names)
    out = small.repartition("img").sortWithinPartitions("img", F.desc("conf"), "ord").mapInArrow(keep, rows.schema)
    if not large.limit(1).count():
        return out
    crowd = rows.join(F.broadcast(large) if few else large, "img", "left_semi").select(*names, F.struct("img", (-F.col("conf")).alias("c"), "ord").alias("__id"))
    ids = numbered(crowd.select("__id"), "n", "__id")
    edges = overlapping(crowd, "__id", threshold).join(ids.select(F.col("__id").alias("a"), F.col("n").alias("i")), "a").join(ids.select(F.col("__id").alias("b"), F.col("n").alias("j")), "b")
    lead = leaders(edges.select("i", "j"), ids.select(F.col("n").alias("id"))).where("id = leader")
    stay = ids.join(lead.select(F.col("id").alias("n")), "n", "left_semi").select("__id")
    return out.unionByName(crowd.join(stay, "__id", "left_semi").drop("__id"))


def per_class(boxes: DataFrame, classes: DataFrame) -> DataFrame:
    """cls_id, name, n, share (percent) of all boxes, in no order."""
    n = boxes.groupBy("cls_id").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    named = n.join(classes, "cls_id", "left").withColumn("name", F.coalesce("name", F.format_string("class_%d", "cls_id")))
    return named.join(F.broadcast(total)).select("cls_id", "name", "n", (F.col("n") * 100 / F.col("total")).alias("share"))


def average_precision(predictions: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """cls_id, ap at an IoU threshold, by all points of the precision-recall curve. predictions: img, cls_id, box corners, conf, ord
    (unique within an image); truth: img, cls_id, corners, ord. A prediction is right if its best box of the truth reaches the
    threshold and no better prediction has that box."""
    p = predictions.select("img", "cls_id", F.struct("x1", "y1", "x2", "y2", "conf", "ord").alias("prediction"))
    t = truth.select("img", "cls_id", F.struct("x1", "y1", "x2", "y2", "ord").alias("truth"))
    return precision_of_rows(p.unionByName(t, allowMissingColumns=True), threshold)


def precision_of_rows(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """average_precision() of rows (img, cls_id, prediction, truth), each with a prediction (a struct of corners, conf, ord), a box of the
    truth (corners, ord) or both, else null there: a table that both come from is shuffled once, by image.

    Of a prediction only its class, place in the order and whether it is right go on. These are sorted in ranges and folded into
    blocks, which keep the places of the right ones; between blocks only a few numbers of each are passed on, so a class that holds
    most rows is no task's alone. Precision falls at wrong ones, so its maxima are at right ones."""
    corners = lambda s: [s[c] for c in ("x1", "y1", "x2", "y2")]
    p, known = F.col("prediction"), F.col("img").isNotNull() & F.col("cls_id").isNotNull()
    boxes = F.collect_list(F.when(known, F.col("truth"))).over(Window.partitionBy("img", "cls_id"))
    asked = p.isNotNull().cast("int").alias("asked")
    # a pair is a row, and its first carries the count of the row's own box of the truth
    pairs = rows.withColumn("boxes", boxes).select("img", "cls_id", "prediction", "truth", asked, F.posexplode_outer(F.when(p.isNotNull(), F.col("boxes"))).alias("at", "box"))
    true = (F.col("truth").isNotNull() & (F.coalesce("at", F.lit(0)) == 0)).cast("int").alias("true")
    met = F.struct(F.coalesce(iou(corners(p), corners(F.col("box"))), F.lit(0.0)).alias("iou"), (-F.col("box.ord")).alias("box"))
    narrow = pairs.select("img", "cls_id", p["ord"].alias("ord"), p["conf"].alias("conf"), "asked", met.alias("m"), true)
    best = narrow.groupBy("img", "cls_id", "ord", "conf", "asked").agg(F.max("m").alias("m"), F.sum("true").alias("true"))
    first = F.row_number().over(Window.partitionBy("img", "cls_id", "m.box").orderBy(F.desc("asked"), F.desc("conf"), "ord")) == 1
    right = (F.col("asked") == 1) & (F.col("m.iou") >= threshold) & first
    flags = F.col("asked") + 2 * right.cast("int") + 4 * F.col("true")  # the last is a count
    order = ["cls_id", F.desc("conf"), "img", "ord"]
    hits = written(best.withColumn("flags", flags).select("cls_id", "conf", "img", "ord", "flags"))  # ranges are found by a pass of its own
    sorted_rows = hits.repartitionByRange(*order).sortWithinPartitions(*order).select("cls_id", "flags", F.spark_partition_id().alias("part"))

    def folded(batches):
        import numpy as np
        import pyarrow as pa

        block = 0
        for batch in batches:
            classes, flags = batch.column("cls_id"), batch.column("flags").to_numpy()
            codes = classes.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            bounds = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1], True]) if len(codes) else np.zeros(1, np.int64)
            runs = [flags[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            right = [np.cumsum(f & 1, dtype=np.int32)[f & 2 > 0] for f in runs]
            ints = lambda values: pa.array(values, pa.int64())
            numbers = [ints(range(block, block + len(runs))), ints([int((f & 1).sum()) for f in runs]), ints([int((f >> 2).sum()) for f in runs]), ints([len(r) for r in right])]
            block += len(runs)
            yield pa.RecordBatch.from_arrays([classes.take(pa.array(bounds[:-1])), batch.column("part").take(pa.array(bounds[:-1])), *numbers, pa.array(right, pa.list_(pa.int32()))], ["cls_id", "part", "block", "asked", "true", "right", "at"])

    schema = sorted_rows.drop("flags").schema.add("block", "long").add("asked", "long").add("true", "long").add("right", "long").add("at", ArrayType(IntegerType()))
    blocks = written(sorted_rows.mapInArrow(folded, schema))
    dropped(hits)
    few = blocks.limit(1_000_001).count() <= 1_000_000  # a block is one row, so their numbers are small beside the places in them
    with_numbers = lambda rows, numbers: rows.join(F.broadcast(numbers) if few else numbers, ["part", "block"])
    earlier = Window.partitionBy("cls_id").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("part", "block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("asked", "right")])
    placed = with_numbers(blocks, before)
    precision = F.transform("at", lambda k, i: (F.col("right_before") + i + 1) / (F.col("asked_before") + k))
    later = Window.partitionBy("cls_id").orderBy(F.desc("part"), F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    after = placed.select("cls_id", "part", "block", F.array_max(precision).alias("top")).select("part", "block", F.max("top").over(later).alias("most"))
    start = F.struct(F.coalesce("most", F.lit(0.0)).alias("most"), F.lit(0.0).alias("sum"))
    step = lambda a, x: F.struct(F.greatest(a["most"], x).alias("most"), (a["sum"] + F.greatest(a["most"], x)).alias("sum"))
    sums = with_numbers(placed, after).select("cls_id", "true", F.aggregate(F.reverse(precision), start, step)["sum"].alias("sum"))
    return sums.groupBy("cls_id").agg(F.sum("true").alias("n"), F.sum("sum").alias("s")).where("n > 0").select("cls_id", (F.col("s") / F.col("n")).alias("ap"))


def mean_average_precision(predictions: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row, map: the mean of average_precision() over the classes of the truth."""
    return mean_of_classes(average_precision(predictions, truth, threshold))


def mean_of_classes(precisions: DataFrame) -> DataFrame:
    """One row, map: the mean of average_precision() or precision_of_rows()."""
    return precisions.agg(F.avg("ap").alias("map"))


#: The 80 class names of the COCO detection set, in the order of their ids, and other words for some of them.
COCO_NAMES = """person, bicycle, car, motorcycle, airplane, bus, train, truck, boat, traffic light, fire hydrant, stop sign, parking meter,
bench, bird, cat, dog, horse, sheep, cow, elephant, bear, zebra, giraffe, backpack, umbrella, handbag, tie, suitcase, frisbee, skis,
snowboard, sports ball, kite, baseball bat, baseball glove, skateboard, surfboard, tennis racket, bottle, wine glass, cup, fork, knife,
spoon, bowl, banana, apple, sandwich, orange, broccoli, carrot, hot dog, pizza, donut, cake, chair, couch, potted plant, bed,
dining table, toilet, tv, laptop, mouse, remote, keyboard, cell phone, microwave, oven, toaster, sink, refrigerator, book, clock, vase,
scissors, teddy bear, hair drier, toothbrush""".replace("\n", " ").split(", ")
COCO_SYNONYMS = {
    "people": "person", "persons": "person", "man": "person", "woman": "person", "human": "person", "bike": "bicycle",
    "automobile": "car", "auto": "car", "lorry": "truck", "van": "car", "aeroplane": "airplane", "plane": "airplane",
    "mobile phone": "cell phone", "telephone": "cell phone", "sofa": "couch", "tv monitor": "tv", "television": "tv", "table": "dining table",
    "pottedplant": "potted plant", "plant": "potted plant", "sportsball": "sports ball", "ball": "sports ball", "motorbike": "motorcycle",
    "trafficlight": "traffic light", "firehydrant": "fire hydrant", "parkingmeter": "parking meter", "tennisracket": "tennis racket",
    "wineglass": "wine glass", "hotdog": "hot dog", "diningtable": "dining table", "cellphone": "cell phone", "hairdrier": "hair drier",
    "hair dryer": "hair drier", "teddybear": "teddy bear",
}


def coco_classes(spark: SparkSession) -> DataFrame:
    """cls_id, name of the COCO detection set."""
    return spark.createDataFrame(list(enumerate(COCO_NAMES)), "cls_id int, name string")


def coco_synonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(COCO_SYNONYMS.items()), "name string, standard string")


def unmatched_names(predictions: DataFrame) -> DataFrame:
    """One row, names: the sorted names of model classes that mapped_predictions() found no class of the dataset for."""
    return predictions.where("not matched and name is not null").agg(F.array_sort(F.collect_set("name")).alias("names"))


def best_class(predictions: DataFrame, confidence: float = 0.25) -> DataFrame:
    """predictions with `scores` (an array, a score for each class) turned into cls_id (the first of the greatest) and conf, of those
    whose conf is above the threshold."""
    top = F.array_max("scores")
    return predictions.withColumn("conf", top).withColumn("cls_id", (F.array_position("scores", top) - 1).cast("int")).where(F.col("conf") > confidence).drop("scores")


def gated(items: DataFrame, labelled: DataFrame, key: str, assist: bool = True, compare: bool = False) -> DataFrame:
    """key, labelled of the items that a model is asked about: unlabelled ones if assistance is on, labelled ones only to compare."""
    rows = items.select(key).join(labelled.select(key).distinct().withColumn("labelled", F.lit(True)), key, "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))
    return rows.where(F.when(F.col("labelled"), F.lit(compare)).otherwise(F.lit(assist)))


def tagged(predictions: DataFrame, compare: bool) -> DataFrame:
    """predictions with is_ai: in compare mode all of them are a model's opinion, which is never saved unless edited; else none."""
    return predictions.withColumn("is_ai", F.lit(compare))


def unlabelled(items: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return items.join(labels.select(key), key, "left_anti")


def pruned_list(listed: DataFrame, removed: DataFrame, key: str = "path") -> DataFrame:
    """A list (of images, or of those to train on) without what was removed."""
    return listed.join(removed.select(key).distinct(), key, "left_anti")


def quarantined(items: DataFrame, removed: DataFrame, folder: str, reason: str) -> DataFrame:
    """path, target, label, label_target, reason for each removed item (path) that there is: where it and its label file (of the items'
    column `label`, null: none) go. Of several of one name all but the first, by path, have _dup and a number in theirs."""
    rows = items.join(removed.select("path").distinct(), "path", "left_semi").withColumn("name", basename(F.col("path")))
    k = F.row_number().over(Window.partitionBy("name").orderBy("path")) - 1
    ending = F.regexp_extract("name", r"(\.[^.]*)?$", 0)
    unique = F.when(F.col("k") == 0, F.col("name")).otherwise(F.concat(stem(F.col("path")), F.lit("_dup"), F.when(F.col("k") > 1, F.col("k").cast("string")).otherwise(""), ending))
    label = F.when(F.col("label").isNotNull(), F.concat(F.lit(folder + "/"), F.regexp_replace(unique, r"\.[^.]*$", ""), F.lit(".txt")))
    return rows.withColumn("k", k).select("path", F.concat(F.lit(folder + "/"), unique).alias("target"), "label", label.alias("label_target"), F.lit(reason).alias("reason"))
