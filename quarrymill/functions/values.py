"""Vectors, bit strings and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The pattern of accepted class names and of round models.
CLASS_NAME, ROUND_MODEL = r"^[A-Za-z0-9_\-]+$", r"_r\d+_m\d{3,4}\.pt$"
#: Endings by which a detector counts as classic, and the number of colours of a cluster map.
CLASSIC, COLOURS = ("ssd", "faster", "retina", "rcnn"), 10


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column, floor: float = 1e-8) -> Column:
    """v over its norm. Both are named by a transform of one element each, so that they are evaluated once a row, and not for every
    element; a unit of a unit was the fourth power of the length in work before."""
    named = lambda x, f: F.transform(F.array(x), f)[0]
    return named(v, lambda w: named(F.greatest(F.sqrt(dot(w, w)), F.lit(floor)), lambda norm: F.transform(w, lambda x: x / norm)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_bits(v: Column, n: int = 64) -> Column:
    """Bit k: whether element k is above zero."""
    terms = [F.when(v[k] > 0, F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")) for k in range(n)]
    out = terms[0]
    for t in terms[1:]:
        out = out.bitwiseOR(t)
    return out


def representativeness(distance: Column) -> Column:
    return 1 / (1 + distance)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def class_name_ok(name: Column) -> Column:
    return (F.length(name) >= 2) & name.rlike(CLASS_NAME)


def model_key(name: Column) -> Column:
    """A weights file's model: without ending, leading best_ and round."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\.pth?$", ""), "^best_", ""), r"_r\d+_m\d{3,4}$", "")


def round_name(model: Column, number: Column, score: Column) -> Column:
    return F.format_string("best_%s_r%d_m%04d.pt", model, number.cast("int"), F.bround(score * 1000).cast("int"))


def round_of(name: Column) -> tuple[Column, Column]:
    """Round and score of a round model's name; null if it is none."""
    part = lambda pattern: F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("int")
    return part(r"_r(\d+)_m\d{3,4}\.pt$"), part(r"_r\d+_m(\d{3,4})\.pt$") / 1000


def is_classic(name: Column) -> Column:
    out = F.lit(False)
    for x in CLASSIC:
        out = out | F.lower(name).contains(x)
    return out


def hash_reason(distance: Column, a: Column, b: Column) -> Column:
    return F.format_string("hamming=%d (%s↔%s)", distance.cast("int"), a, b)


def cosine_reason(similarity: Column) -> Column:
    return F.format_string("cosine=%.3f", similarity)


def least_hamming(a: Column, b: Column) -> Column:
    """distance, a, b: the least Hamming distance between any two of two arrays of longs (a hash for each orientation) and their places,
    the first of equals."""
    pairs = F.flatten(F.transform(a, lambda x, i: F.transform(b, lambda y, j: F.struct(F.bit_count(x.bitwiseXOR(y)).cast("int").alias("distance"), i.alias("a"), j.alias("b")))))
    return F.array_min(pairs)


def promoted(is_ai: Column, edited: Column) -> Column:
    """Whether a box counts as a prediction: not any more once a person has edited it."""
    return F.when(F.coalesce(edited, F.lit(False)), False).otherwise(is_ai)


def prompt(classes: DataFrame) -> DataFrame:
    """One row, prompt: the class names in the order of their ids, joined by ", ", as zero-shot detectors take them."""
    names = F.array_sort(F.collect_list(F.struct("cls_id", "name")))
    return classes.agg(F.array_join(F.transform(names, lambda s: s["name"]), ", ").alias("prompt"))


def round_text(model: Column) -> Column:
    """round=<n> mAP=<score> of a round model's name; null if it is none."""
    number, score = round_of(model)
    return F.when(number.isNotNull(), F.format_string("round=%d mAP=%.3f", number, score))
