"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (P) and a draw from all documents, labelled or not (U), train a linear classifier over words and word
beginnings. With class prior pi, the risk of the negatives is estimated as R_u^- - pi R_p^-, since U is a mixture; where that
falls below zero on the sample (which a true risk can't), the step undoes it (Kiryo et al. 2017, "Positive-Unlabeled Learning
with Non-Negative Risk Estimator"). The logistic loss makes the output an estimate of P(toxic | text).
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BROADCAST_IDS, Bounded, documents
from .tokens import slices

#: The bounds of the training sample (in the mean: rows are drawn by a hash of doc_id), of hashed features, and of those kept.
POSITIVES, UNLABELLED, BUCKETS, FEATURES = 20_000, 40_000, 1 << 20, 4096
#: Standard deviations by which a feature must be more frequent in P than U lets expect.
LIFT = 2.0
#: Lengths of word beginnings that are features, beside the whole word.
BEGINNINGS = (4, 5, 6)
#: A hashed word or beginning is a feature for each of these numbers of different words of the document that share it.
AT_LEAST = (1, 2, 4)
_STRIP = ".,;:!?\"'()[]{}<>|*#%&$-_"


def word_features(word: str) -> tuple[int, ...]:
    word = word.strip(_STRIP).lower()
    if not word:
        return ()
    return tuple({zlib.crc32(f"{n}:{word[:n]}".encode("utf-8", "surrogatepass")) % BUCKETS for n in BEGINNINGS if len(word) > n} | {zlib.crc32(f"w:{word}".encode("utf-8", "surrogatepass")) % BUCKETS})


def levelled(words: set[str], known) -> list[int]:
    """The features of a document: 3 * hash + k for each hash that AT_LEAST[k] of its words or more have. known: a word's hashes."""
    n = Counter(f for word in words for f in known[word])
    return [3 * f + k for f, c in n.items() for k, least in enumerate(AT_LEAST) if c >= least]


def held_out(doc_id="doc_id"):
    """crc32 of doc_id as text, modulo 4, is 2. Null doc_id: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    features: np.ndarray  # as levelled() gives them, ascending
    weights: np.ndarray
    bias: float
    prior: float

    def scorer(self, cache: int = 300_000):
        at = {int(f): float(w) for f, w in zip(self.features, self.weights)}
        bases = {f // 3 for f in at}
        known = Bounded(lambda word: tuple(f for f in word_features(word) if f in bases), cache)

        def score(text: str) -> float:
            found = sorted(at[f] for f in levelled(set(text.split()), known) if f in at)
            return 1 / (1 + np.exp(-np.clip(self.bias + sum(found), -40, 40)))

        return score


def nnpu(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float | None = None, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam on the whole sample: the mean over the second half of the steps,
    since those that undo swing about the bound. rows: the features of each document. decay: of weights; by default 1 / (rows of
    P), a normal prior of unit variance."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    p, u = positive, ~positive
    n_p, n_u = max(1, p.sum()), max(1, u.sum())
    decay = 1 / n_p if decay is None else decay
    w, b = np.zeros(n_features), np.log(prior / (1 - prior))
    m, v, mean, late = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1), steps - steps // 2
    for t in range(1, steps + 1):
        z = b + np.bincount(at, w[col], len(rows))
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        minus = np.logaddexp(0, z)  # the loss as a negative
        rest = minus[u].sum() / n_u - prior * minus[p].sum() / n_p
        towards = np.where(u, s / n_u, -prior * s / n_p)
        g = -towards if rest < -beta else towards + np.where(p, prior * (s - 1) / n_p, 0)
        grad = np.append(np.bincount(col, g[at], n_features) + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
        if t > steps - late:
            mean += np.append(w, b) / late
    return mean[:-1], float(mean[-1])


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES, prior: float | None = None) -> Model:
    """Learns from documents that are not held out. P: those labelled toxic. U: a draw from all, whether labelled or not; no label
    of theirs is looked at. prior: the share of toxic documents in U; by default that of the toxic ones among the labelled, the
    only use of labels that are not toxic. Without a positive, or without documents, the model gives a constant, low score."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(~held_out())
    n, n_pos = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    none = Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((n_pos + 1) / (n + 20))), (n_pos + 1) / (n + 20))
    own = documents(docs).where("doc_id is not null").where(~held_out())
    total = own.count() if n_pos and (n_pos < n or prior is not None) else 0
    if not total:
        return none
    draw = lambda *of: F.pmod(F.xxhash64(*of), F.lit(1 << 30)) / F.lit(float(1 << 30))
    p = known.where("toxic = 1").where(draw(F.lit(11), "doc_id") < positives / n_pos).select("doc_id", F.lit(True).alias("p"))
    few = p.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    drawn = own.withColumn("u", draw(F.lit(12), "doc_id", "text") < unlabelled / total).join(F.broadcast(p) if few else p, "doc_id", "left").where("p or u").select("text", F.coalesce("p", F.lit(False)).alias("p"), "u")
    sample = drawn.persist()
    try:
        return _fitted(sample, none, features, n_pos / n if prior is None else prior)
    finally:
        sample.unpersist()


def _fitted(sample: DataFrame, none: Model, features: int, prior: float) -> Model:
    prior = min(max(prior, 1e-4), 1 - 1e-4)

    def count(batches):
        counts, known = np.zeros((2, 3 * BUCKETS), np.int32), Bounded(word_features, 300_000)
        for batch in batches:
            for text, p, u in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = levelled(set(text.split()), known)
                counts[0, found] += p
                counts[1, found] += u
        own = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(counts[0, own], pa.int64()), pa.array(counts[1, own], pa.int64())], names=["f", "p", "u"])

    n_p, n_u = sample.agg(F.sum(F.col("p").cast("long")), F.sum(F.col("u").cast("long"))).first()
    if not n_p or not n_u:
        return none
    expected = F.col("u") * (n_p / n_u)
    lift = ((F.col("p") - expected) / F.sqrt(expected + 1)).alias("lift")
    best = sample.mapInArrow(count, "f long, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).select("f", lift).where(F.col("lift") > LIFT).orderBy(F.desc("lift"), "f").limit(features).collect()
    chosen = np.array(sorted(r.f for r in best), np.int64)
    if not len(chosen):
        return none
    index = {int(f): k for k, f in enumerate(chosen)}

    def rows(batches):
        bases = {f // 3 for f in index}
        known = Bounded(lambda word: tuple(f for f in word_features(word) if f in bases), 300_000)
        for batch in batches:
            found = [sorted(index[f] for f in levelled(set(text.split()), known) if f in index) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([np.array(r, "<u2").tobytes() for r in found], pa.binary()), batch.column(1), batch.column(2)], names=["row", "p", "u"])

    got = sample.mapInArrow(rows, "row binary, p boolean, u boolean").collect()
    own = [(np.frombuffer(r.row, "<u2"), side) for r in got for side, there in ((True, r.p), (False, r.u)) if there]
    order = sorted(range(len(own)), key=lambda i: (own[i][1], own[i][0].tobytes()))
    weights, bias = nnpu([own[i][0] for i in order], np.array([own[i][1] for i in order]), len(chosen), prior)
    return Model(chosen, weights, bias, prior)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. Null text: empty. Null doc_id and repeated rows: scored each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        of = shared.value.scorer()
        for batch in batches:
            for part in slices(batch):
                scores = [float(of(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, score double").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
