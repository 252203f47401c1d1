"""The layered scan for duplicate images: equal bytes, then perceptual hashes in eight orientations, then the pixels.

Pictures whose eight hashes and eight grays are the same, in whatever order, are one class: they have the same neighbours, so the first
stands for all, and a thousand flat pictures are one row. Classes meet on parts of hashes; a pair that meets on several is given
once. Where pixels are compared, classes whose mean grays are too far apart to pass do not meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..functions import pixels as px
from ..functions.values import hash_reason
from ..sources import files
from .groups import band_bounds, exact_groups, leaders, numbered, written

#: Bytes of images that go to a Python worker at once, about (a larger image goes alone).
BATCH_BYTES = 64 << 20
BITS, WORDS, SIDE = 256, 4, 128


def described(image: Column, most: int) -> Column:
    """Of an image as Spark's image source has it: words (a hash of 4 longs for each orientation), keys (the distinct parts of these
    hashes, of which hashes at most `most` bits apart share one), gray (the gate's bytes), mean (of the gray), quality, and alike (a
    digest that pictures share if they have the same hashes and grays in some order). Null for unreadable ones."""
    bands = band_bounds(most, BITS)

    def parts(hashes: list[np.ndarray]) -> list[int]:
        found = []
        for k, (a, n) in enumerate(bands):
            found += sorted({int.from_bytes(hashlib.blake2b(bytes([k % 256, k // 256]) + np.packbits(h[a : a + n]).tobytes(), digest_size=8).digest(), "little", signed=True) for h in hashes})
        return found

    def run(images: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in images.itertuples():
            if r.height is None or not r.height > 0:
                out.append((None,) * 6)
                continue
            x = px.gray(r.data, int(r.height), int(r.width), int(r.nChannels))
            hashes, quality = px.wide_hashes(x)
            gray = np.rint(px.shrunk(x, SIDE)).astype(np.uint8)
            packed = [np.packbits(h, bitorder="little").tobytes() for h in hashes]
            alike = hashlib.sha256(b"".join(sorted(packed)) + min(np.ascontiguousarray(y).tobytes() for y in px.oriented(gray))).hexdigest()
            out.append((np.frombuffer(b"".join(packed), "<i8").tolist(), parts(hashes), gray.tobytes(), float(gray.mean()), quality, alike))
        return pd.DataFrame(out, columns=["words", "keys", "gray", "mean", "quality", "alike"])

    return F.pandas_udf(run, "struct<words:array<long>,keys:array<long>,gray:binary,mean:double,quality:int,alike:string>")(image)


def classes(rows: DataFrame) -> DataFrame:
    """id, class: of rows (id, alike) the least id of those that are alike."""
    least = rows.groupBy("alike").agg(F.min("id").alias("class"))
    return rows.select("id", "alike").join(least, "alike").select("id", "class")


def turned_distance(a: Column, b: Column) -> Column:
    """distance, a, b: the least distance of any orientation of one to any of the other, and their places (the first of equals)."""

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = np.empty((len(x), 3), np.int32)
        for k, (p, q) in enumerate(zip(x, y)):
            p, q = (np.asarray(v, np.int64).view(np.uint64).reshape(-1, WORDS) for v in (p, q))
            far = np.bitwise_count(p[:, None] ^ q[None]).sum(axis=2, dtype=np.int32)
            i, j = divmod(int(np.argmin(far)), len(q))
            out[k] = far[i, j], i, j
        return pd.DataFrame(out, columns=["distance", "a", "b"])

    return F.pandas_udf(run, "struct<distance:int,a:int,b:int>")(a, b)


def candidates(rows: DataFrame, width: float | None = None) -> DataFrame:
    """i < j: rows (id, keys, mean) that share a key, once each; with width only those whose means may be less than that apart."""
    cell = F.lit(0) if width is None else F.floor(F.col("mean") / width)
    own = rows.select("id", "keys", cell.cast("int").alias("cell"))
    left = own.select(F.col("id").alias("i"), F.col("keys").alias("ki"), "cell", F.explode("keys").alias("key"))
    near = F.array(F.col("cell")) if width is None else F.sequence(F.col("cell") - 1, F.col("cell") + 1)
    right = own.select(F.col("id").alias("j"), F.col("keys").alias("kj"), F.explode(near).alias("cell"), "keys").select("j", "kj", "cell", F.explode("keys").alias("key"))
    return left.join(right, ["key", "cell"]).where("i < j").where(F.get(F.array_intersect("ki", "kj"), 0) == F.col("key")).select("i", "j")


def hash_pairs(rows: DataFrame, most: int, width: float | None = None) -> DataFrame:
    """i < j, distance, a, b: of rows (id, words, keys, mean) at most `most` bits apart in any two orientations the least distance and
    its orientations."""
    side = lambda key, words: rows.select(F.col("id").alias(key), F.col("words").alias(words))
    both = candidates(rows, width).join(side("i", "wi"), "i").join(side("j", "wj"), "j")
    return both.select("i", "j", turned_distance(F.col("wi"), F.col("wj")).alias("m")).select("i", "j", "m.*").where(F.col("distance") <= most)


class Counted:
    """Counts rows while they are written, without a pass of their own (Observation)."""

    def __init__(self, told=None):
        self.told = told

    def written(self, df: DataFrame, phase: str) -> DataFrame:
        if self.told is None:
            return written(df)
        seen = Observation()
        out = written(df.observe(seen, F.count(F.lit(1)).alias("n")))
        self.told(seen.get["n"], seen.get["n"], phase)
        return out


def gated(pairs: DataFrame, rows: DataFrame, pixel: float, reach: int, factor: float) -> DataFrame:
    """The pairs whose gray images (id, gray) are alike, as they are or after a small shift."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        picture = lambda data: np.frombuffer(data, np.uint8).reshape(SIDE, SIDE).astype(np.float32)
        return pd.Series([px.same_picture(picture(x), picture(y), pixel, reach, factor) for x, y in zip(a, b)], dtype=bool)

    side = lambda key, gray: rows.select(F.col("id").alias(key), F.col("gray").alias(gray))
    return pairs.join(side("i", "ga"), "i").join(side("j", "gb"), "j").where(F.pandas_udf(run, "boolean")("ga", "gb")).drop("ga", "gb")


def scan(spark: SparkSession, folder: str, most: int = 5, pixel: float | None = 6.0, reach: int = 2, factor: float = 3.0, least_quality: int = 0, told=None) -> DataFrame:
    """layer, group_id, path, pos, distance, reason, is_keeper of all members of duplicate groups of a folder's images.

    L1: equal bytes, by path. The first of each L1 group, then all other images by path, go on: each that no earlier leader
    claimed leads and claims later ones at most `most` of 256 bits away in any two orientations whose pixels pass the gate (mean
    difference of 128 x 128 grays up to `pixel`, or, up to `factor` times that, after a shift of up to `reach`; None: no gate).
    L3: a member matched in a turned or mirrored form; else L2. Of an L3 group the copy matched in its own orientation is kept.
    Images are upright as their EXIF asks. Unreadable images, and those of a hash quality below `least_quality`, take part in L1
    alone. group_id counts from 0 in L1 and anew in L2 and L3 together. told: called with (rows done, rows, phase) after each
    phase, from what Spark counts while it writes."""
    count = Counted(told)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        found = files.images(spark, folder, content=True).withColumn("uri", files.plain_uri(F.col("uri")))
        exact = count.written(exact_groups(found, F.col("content"), "path"), "bytes")
        firsts = found.select("path", "uri").join(exact.select("path", "pos"), "path", "left").where("coalesce(pos, 0) = 0")
        ordered = numbered(firsts.select("path", "uri", F.col("pos").isNull().alias("single")), "id", "single", "path")
        images = files.upright_pixels(spark, folder)
        seen = images.select(files.plain_uri(F.col("origin")).alias("uri"), described(F.struct(*images.columns), most).alias("d"))
        rows = count.written(ordered.join(seen, "uri").where(f"d.words is not null and d.quality >= {int(least_quality)}").select("id", "path", "d.*"), "hashes")
        member = written(classes(rows))
        own = rows.join(member.where("id = class").select("id"), "id")
        pairs = count.written(hash_pairs(own, most, None if pixel is None else pixel * max(1.0, factor) + 1), "pairs")
        edges = pairs if pixel is None else count.written(gated(pairs, rows, pixel, reach, factor), "pixels")
        led = leaders(edges.select("i", "j"), own.select("id")).withColumnRenamed("id", "class")
        led = written(member.join(led, "class").where("leader != id").select("leader", "id"))
        side = lambda key, words: rows.select(F.col("id").alias(key), F.col("words").alias(words))
        links = led.join(side("leader", "wi"), "leader").join(side("id", "wj"), "id")
        links = written(links.select("leader", "id", turned_distance(F.col("wi"), F.col("wj")).alias("m")).select("leader", "id", "m.*"))
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)

    # the first link that tells an original decides: the member's if it alone has its own orientation, else the leader's
    told = F.when(F.col("a") == 0, F.col("leader")).when(F.col("b") == 0, F.col("id"))
    group = links.groupBy("leader").agg(F.max((F.col("a") != 0) | (F.col("b") != 0)).alias("turned"), F.min(F.when(told.isNotNull(), F.struct("id", told.alias("keeper")))).alias("told"))
    group = numbered(group.select("leader", "turned", F.coalesce("told.keeper", "leader").alias("keeper")), "group_id", "leader")
    label = lambda k: F.element_at(F.array(*map(F.lit, px.LABELS)), F.col(k) + 1)
    linked = written(links.join(group, "leader").select("group_id", "turned", "leader", "id", "keeper", F.col("distance").cast("double").alias("distance"), hash_reason(F.col("distance"), label("a"), label("b")).alias("reason")))
    # a leader that isn't kept has the distance and reason of its link to the one that is
    heads = linked.groupBy("group_id", "turned", "leader", "keeper").agg(F.max(F.when(F.col("id") == F.col("keeper"), F.struct("distance", "reason"))).alias("own"))
    heads = heads.select("group_id", "turned", F.col("leader").alias("id"), "keeper", F.coalesce("own.distance", F.lit(0.0)).alias("distance"), F.coalesce("own.reason", F.lit("representative")).alias("reason"))
    members = heads.unionByName(linked.drop("leader")).withColumn("is_keeper", F.col("id") == F.col("keeper"))
    kept = lambda c, value: F.when(F.col("is_keeper"), F.lit(value)).otherwise(F.col(c)).alias(c)
    place = numbered(members, "place", "group_id", F.desc("is_keeper"), "id")
    start = place.groupBy("group_id").agg(F.min("place").alias("start"))
    place = place.join(start, "group_id").withColumn("pos", (F.col("place") - F.col("start")).cast("int")).join(rows.select("id", "path"), "id")
    similar = place.select(F.when(F.col("turned"), "L3").otherwise("L2").alias("layer"), "group_id", "path", "pos", kept("distance", 0.0), kept("reason", "representative"), "is_keeper")
    equal = exact.select(F.lit("L1").alias("layer"), F.col("gid").alias("group_id"), "path", F.col("pos").cast("int").alias("pos"), F.lit(0.0).alias("distance"), F.lit("sha256_match").alias("reason"), (F.col("pos") == 0).alias("is_keeper"))
    return equal.unionByName(similar)
