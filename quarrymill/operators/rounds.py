"""Labelling rounds: history, model choice, progress, and the state of the loop."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.values import CLASSIC, COLOURS, ROUND_MODEL
from .groups import numbered


def upserted(history: DataFrame, new: DataFrame) -> DataFrame:
    """History with new rows: of several rows of one round the last stays (`seq` tells the order)."""
    rows = history.withColumn("__s", F.lit(0)).unionByName(new.withColumn("__s", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("round").orderBy(F.desc("__s"), F.desc("seq"))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__s")


def deltas(history: DataFrame) -> DataFrame:
    """Each round's score less the round's before (history has a row a round, so the one window is small)."""
    return history.withColumn("delta", F.col("mAP") - F.lag("mAP").over(Window.orderBy("round")))


def best_model(history: DataFrame, files: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """model, source: of the history's models that have a file that of the highest score (the earliest round of equals), else the one
    that the record of the last round (model) names, if it has a file, else the newest file. files: model, modified."""
    there = history.join(files.select("model"), "model", "left_semi").agg(F.max_by("model", F.struct("mAP", -F.col("round"))).alias("model"), F.lit(1).alias("p"))
    both = there.union(files.agg(F.max_by("model", "modified").alias("model"), F.lit(3).alias("p")))
    if last is not None:
        both = both.union(last.join(files.select("model"), "model", "left_semi").agg(F.min("model").alias("model"), F.lit(2).alias("p")))
    found = both.where("model is not null").agg(F.min(F.struct("p", "model")).alias("m")).where("m is not null")
    return found.select("m.model", F.element_at(F.array(*map(F.lit, ("history", "last round", "newest"))), F.col("m.p")).alias("source"))


def trained_models(history: DataFrame, files: DataFrame) -> DataFrame:
    """model, score, of the history's models that have a file and of files with a round's name (score 0), by falling score: place."""
    told = history.groupBy("model").agg(F.min_by(F.coalesce("mAP", F.lit(0.0)), "round").alias("score"))
    named = files.where(F.col("model").rlike(ROUND_MODEL)).select("model")
    found = told.join(files.select("model").distinct(), "model", "left_semi").unionByName(named.join(told, "model", "left_anti").distinct().withColumn("score", F.lit(0.0)))
    return numbered(found, "place", F.desc("score"), "model")


def deployed_model(base: str, best: DataFrame, files: DataFrame, assist: bool, world: str) -> DataFrame:
    """model, source, for the base model's name: of a classic base its own trained file, else the best round model (of best_model());
    without one the zero-shot model if assistance is on, else the base itself."""
    classic = any(x in base.lower() for x in ("ssd", "faster", "retina"))
    own = files.where(F.col("model") == f"best_{base}.pth").select("model", F.lit("trained").alias("source")) if classic else best.select("model", F.lit("best round").alias("source"))
    spare = files.sparkSession.createDataFrame([(world, "zero-shot") if assist else (base + (".pth" if classic else ".pt"), "base")], "model string, source string")
    ranked = own.withColumn("p", F.lit(0)).unionByName(spare.withColumn("p", F.lit(1)))
    return ranked.agg(F.min_by(F.struct("model", "source"), "p").alias("m")).select("m.*")


def start_weights(selected: str, strategy: str, best: str | None, files: set[str], custom: bool = False) -> str:
    """The file that training starts from. A file chosen by path (custom) wins; else, by strategy: transfer: the base model; scratch: its
    blueprint (of families that have none the base); recursive: the chosen archived model, else the best round model, else the base;
    of a classic model its own trained file, else the base. files: names that exist."""
    if custom:
        return selected
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy}: one of {', '.join(STRATEGIES)}")
    key = re.sub(r"_r\d+_m\d{3,4}$", "", re.sub(r"\.pth?$", "", selected).removeprefix("best_"))
    classic = any(x in key.lower() for x in CLASSIC)
    base = key + (".pth" if classic else ".pt")
    if strategy == "transfer":
        return base
    if strategy == "scratch":
        return f"{key}.pt" if any(x in key.lower() for x in ("rtdetr", "world")) else f"{key}.yaml"
    if classic:
        return f"best_{base}" if f"best_{base}" in files else base
    return selected if selected.endswith((".pt", ".pth")) and selected in files else best or base


def closed_round(history: DataFrame, entry: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a finished training leaves: the history with its entry (round, model, mAP, epochs, seq and more; the last of a round stays),
    the record of the last round, and the model to deploy: that of the highest score, the new one of equals."""
    table = upserted(history, entry)
    record = entry.agg(F.max_by(F.struct("round", "model", "mAP", "epochs"), "seq").alias("r")).select("r.*")
    new = record.select(F.col("model").alias("__new"))
    deploy = table.join(F.broadcast(new)).agg(F.max_by("model", F.struct("mAP", F.col("model") == F.col("__new"), -F.col("round"))).alias("model"))
    return table, record, deploy


def progress(clusters: DataFrame, labelled: DataFrame, created: Column, target: int | None = None) -> DataFrame:
    """One row: reps_done, extras (labelled after the map was made, no representatives), done, target. clusters: representative and,
    where the map has no target of its own, cluster_id (then it is the highest + 1; without ids the number of representatives).
    labelled: path, modified. created: a time, see created_at()."""
    reps = clusters.select(F.col("representative").alias("path"), F.lit(True).alias("rep")).distinct()
    rows = labelled.join(reps, "path", "left")
    out = rows.agg(F.count("rep").alias("reps_done"), F.count(F.when(F.col("rep").isNull() & (F.col("modified") > created), 1)).alias("extras"))
    legacy = F.max("cluster_id") + 1 if "cluster_id" in clusters.columns else F.countDistinct("representative")
    goal = clusters.agg((F.lit(target) if target else legacy).cast("long").alias("target"))
    return out.join(F.broadcast(goal)).withColumn("done", F.col("reps_done") + F.col("extras"))


def created_at(text: Column, fallback: Column) -> Column:
    """The time that a map's `created` tells ("2024-05-01 10:00:00"); the file's own time where that is missing or no time."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), fallback)


def with_status(clusters: DataFrame, cluster_id: int, status: str) -> DataFrame:
    """clusters with the status of one set."""
    return clusters.withColumn("status", F.when(F.col("cluster_id") == cluster_id, status).otherwise(F.col("status")))


def target_count(remaining: Column, low: int = 5, high: int = 50) -> Column:
    return F.least(F.greatest(F.floor(0.05 * remaining).cast("int"), F.lit(low)), F.lit(high))


def reference_k(n: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(0.05 * n).cast("int"))


@dataclass(frozen=True)
class RoundState:
    training: bool = False
    deferred: bool = False
    armed: bool = True


def step(state: RoundState, event: str) -> tuple[RoundState, str]:
    """The next state and what to do (setup, notice or nothing) on quota_met, training_started, training_succeeded, training_failed."""
    if event == "training_started":
        return replace(state, training=True), "nothing"
    if event == "training_succeeded":
        return RoundState(), "setup" if state.deferred else "nothing"
    if event == "training_failed":
        return replace(state, training=False), "nothing"
    if event != "quota_met":
        raise ValueError(event)
    if state.training:
        return replace(state, deferred=True), "nothing" if state.deferred else "notice"
    return replace(state, armed=False), "setup" if state.armed else "nothing"


#: Epochs and frozen layers of the training strategies; feature sizes of the embedding backends.
STRATEGIES = {"transfer": (40, 10), "recursive": (30, 0), "scratch": (100, 0)}
BACKENDS = {"mobilenet_v3": 576, "efficientnet_b0": 1280, "resnet50": 2048}


def recommended_backend(has_gpu: bool, memory_gb: float) -> str:
    return "resnet50" if has_gpu else "efficientnet_b0" if memory_gb >= 16 else "mobilenet_v3"


def training_settings(machines: DataFrame) -> DataFrame:
    """machines (gpu, gb, strategy) with what a training on each takes: epochs, frozen, backend, dims. Strategies that aren't known have
    null epochs and frozen layers; a machine of unknown memory gets the smallest backend."""
    pairs = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    backend = F.when(F.col("gpu"), recommended_backend(True, 0)).when(F.col("gb") >= 16, recommended_backend(False, 16)).otherwise(recommended_backend(False, 0))
    out = machines.withColumn("epochs", F.try_element_at(pairs({k: e for k, (e, _) in STRATEGIES.items()}), F.col("strategy")))
    out = out.withColumn("frozen", F.try_element_at(pairs({k: f for k, (_, f) in STRATEGIES.items()}), F.col("strategy")))
    return out.withColumn("backend", backend).withColumn("dims", F.try_element_at(pairs(BACKENDS), F.col("backend")))


def cluster_map(members: DataFrame, medoids: DataFrame) -> DataFrame:
    """cluster_id, colour (of ten, by number), representative, members (of a cluster without any the representative), status. members:
    cluster, id; medoids: cluster, medoid."""
    sized = members.groupBy("cluster").agg(F.sort_array(F.collect_list("id")).alias("members"))
    own = F.coalesce("members", F.array("medoid"))
    return medoids.join(sized, "cluster", "left").select(F.col("cluster").alias("cluster_id"), F.pmod("cluster", F.lit(COLOURS)).alias("colour"), F.col("medoid").alias("representative"), own.alias("members"), F.lit("pending").alias("status"))


def pruned(clusters: DataFrame, removed: DataFrame) -> DataFrame:
    """Clusters whose representative is removed go; removed members leave theirs. removed: id."""
    left = clusters.join(removed.select(F.col("id").alias("representative")), "representative", "left_anti")
    flat = left.select("cluster_id", F.explode("members").alias("id")).join(removed, "id", "left_anti").groupBy("cluster_id").agg(F.sort_array(F.collect_list("id")).alias("members"))
    return left.drop("members").join(flat, "cluster_id")


def pruned_members(members: DataFrame, removed: DataFrame) -> DataFrame:
    """The same on rows (id, representative), which no cluster's size can make too large. removed: id."""
    left = members.join(removed.select(F.col("id").alias("representative")), "representative", "left_anti")
    return left.join(removed.select("id"), "id", "left_anti").select("id", "representative")
