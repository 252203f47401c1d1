"""Quality rules whose cutoffs are chosen on labelled documents so that false rejection is limited in every stratum.

Each rule rejects a document whose value lies above a cutoff. For each stratum (language) and rule the cutoffs of a fixed grid
are tested from the loosest to the tightest: with k of n good documents above a cutoff, the hypothesis "more than `limit` of
the good documents of this stratum are above it" is rejected if P(Binomial(n, limit) <= k) <= delta / (strata * rules); that is
the exact (Clopper-Pearson) upper bound at that level. Testing stops at the first cutoff that can't be certified, so all the
certified ones hold at once with probability 1 - delta (fixed sequence within, Bonferroni between strata and rules), and any
of them may be used: the one that rejects most bad documents over good ones, the loosest of equals. The limits of the rules
add up, so of the good documents of a stratum at most `limit` times the number of rules is rejected.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import SPACES, keep_ids, small_batches, trim, written

#: value = scale * count / base, in whole steps of the grid: rule, count, base, steps a unit, highest step.
RULES = (("symbols", "n_symbols", "n_words", 50, 100), ("duplicate_lines", "n_dup_lines", "n_lines", 50, 50), ("repeated_words", "n_repeat_words", "n_words", 50, 50), ("capitals", "n_upper", "word_chars", 50, 50))
#: Strata up to this number: their cutoffs (four numbers each) are broadcast. More are joined by a shuffle.
STRATA_BROADCAST = 10_000
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"
_SYMBOLS = b"#*$%&|<>"


def repeat_words(ids: np.ndarray) -> int:
    """Words in 3-word windows that are found twice or more, of words given as numbers below their count."""
    n = len(ids)
    if n < 4:
        return 0
    v = int(ids.max()) + 1
    pairs = ids[:-1] * v + ids[1:]
    if v > 1 << 20:  # else the triples fit in 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    triples = pairs[:-1] * v + ids[2:]
    order = np.argsort(triples, kind="stable")
    same = np.diff(triples[order]) == 0
    if not same.any():
        return 0
    found = np.zeros(n - 2, bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    starts = np.flatnonzero(found)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def measure(text: str) -> tuple[int, ...]:
    """The METRICS of a text. Words: runs of characters other than ASCII white space."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, 0, 0
    chars = len(text) - (len(data) - len(data.translate(None, SPACES)))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    seen, lines, dups = set(), 0, 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            dups += line in seen
            seen.add(line)
    distinct: dict[bytes, int] = {}
    ids = np.fromiter([distinct.setdefault(w, len(distinct)) for w in words], np.int64, n)
    repeated = repeat_words(ids) if len(distinct) < n else 0
    upper = sum(map(str.isupper, text)) if not text.isascii() else len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return n, chars, symbols, dups, repeated, lines, upper


def metrics_udf():
    @F.pandas_udf(METRICS)
    def metrics(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in METRICS.split(", ")]
        for text in batches:
            trim()
            yield pd.DataFrame([measure(t or "") for t in text], columns=names, dtype="int64")

    return metrics


def with_metrics(docs: DataFrame, name: str) -> DataFrame:
    """docs and a struct of METRICS, base_failed, stratum and the rules' grid steps under a name that no column has."""
    m = lambda c: F.col(f"{name}.{c}")
    out = docs.withColumn(name, metrics_udf()(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    steps = [F.least(F.lit(top), F.coalesce(F.floor(steps * m(count) / F.nullif(m(base), F.lit(0))), F.lit(0))).cast("int").alias(rule) for rule, count, base, steps, top in RULES]
    failed = (m("n_words") < 50) | (100 * m("n_repeat_words") > 50 * m("n_words"))
    stratum = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    return out.withColumn(name, F.struct(f"{name}.*", failed.alias("base_failed"), stratum.alias("stratum"), *steps))


def tail(n: int, k: int, p: float) -> float:
    """P(Binomial(n, p) <= k), exactly but for rounding."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i]) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def choose(good: np.ndarray, bad: np.ndarray, limit: float, level: float) -> int | None:
    """The cutoff step (reject above it) from counts by step, or None if none can be certified."""
    n, best, chosen = int(good.sum()), 0, None
    above_good = above_bad = 0
    for step in range(len(good) - 2, -1, -1):
        above_good, above_bad = above_good + int(good[step + 1]), above_bad + int(bad[step + 1])
        if not n or tail(n, above_good, limit) > level:
            break
        if chosen is None or above_bad - above_good > best:
            best, chosen = above_bad - above_good, step
    return chosen


def cutoffs(docs: DataFrame, labels: DataFrame, limit: float = 0.005, delta: float = 0.05) -> DataFrame:
    """stratum and a cutoff step for each rule (null: no rule), from all labelled documents that the base rules keep. A document
    with several labels counts as good if one of them says so. Counts are aggregated by stratum, rule and step; none of the
    tables grows with the documents but in the number of strata."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") >= 1).cast("long").alias("good"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(["lang"] if "lang" in docs.columns else []))
    found = with_metrics(keep_ids(own, known.select("doc_id"), "doc_id"), "m").select("doc_id", "m.*").where("not base_failed").join(known, "doc_id")
    steps = F.explode(F.array(*[F.struct(F.lit(r[0]).alias("rule"), F.col(r[0]).alias("step")) for r in RULES]))
    rows = found.select("stratum", "good", steps.alias("r")).groupBy("stratum", "r.rule", "r.step").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    rows = written(rows, "histograms")
    strata = rows.select("stratum").distinct().count()
    tops = {r[0]: r[4] for r in RULES}

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros(tops[key[1]] + 1, np.int64), np.zeros(tops[key[1]] + 1, np.int64)
        good[pdf.step], bad[pdf.step] = pdf.good, pdf.bad
        return pd.DataFrame({"stratum": [key[0]], "rule": [key[1]], "cutoff": pd.array([choose(good, bad, limit, delta / (max(1, strata) * len(RULES)))], dtype="Int32")})

    chosen = rows.groupBy("stratum", "rule").applyInPandas(one, "stratum string, rule string, cutoff int")
    return chosen.groupBy("stratum").pivot("rule", [r[0] for r in RULES]).agg(F.first("cutoff"))


def judged(docs: DataFrame, labels: DataFrame, name: str = "quality", limit: float = 0.005, delta: float = 0.05) -> DataFrame:
    """docs with a struct `name`: METRICS, base_failed, kept. A document of a stratum without labelled ones is judged by the base
    rules alone. Null text: no words, so base_failed. Null lang: the stratum ''. Null doc_id: judged as any other."""
    small_batches(docs.sparkSession)
    found = cutoffs(docs, labels, limit, delta)
    few = found.limit(STRATA_BROADCAST + 1).collect()
    if len(few) <= STRATA_BROADCAST:
        found = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in few], found.schema))
    at = "q" + uuid.uuid4().hex
    cut = found.select(F.col("stratum").alias(at + "s"), F.struct(*[r[0] for r in RULES]).alias(at + "c"))
    out = with_metrics(docs, at).join(cut, F.col(f"{at}.stratum") == F.col(at + "s"), "left")
    above = [F.coalesce(F.col(f"{at}.{r[0]}") > F.col(f"{at}c.{r[0]}"), F.lit(False)) for r in RULES]
    kept = ~F.col(f"{at}.base_failed")
    for x in above:
        kept = kept & ~x
    names = [x.split()[0] for x in METRICS.split(", ")]
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(*[F.col(f"{at}.{c}") for c in names], F.col(f"{at}.base_failed"), kept.alias("kept")).alias(name))
