"""Near duplicates by a chosen-path set similarity join.

Each document is the set of its distinct 3-word shingles (64-bit hashes) and has a signature of 64 minwise values. In each of
several independent trees a node picks, by a hash of its path, one or two of the 64 coordinates (in the mean 1 / 0.85, so that
a pair of similarity 0.85 stays together in one child in the mean) and passes each document on to the child of its value
there. A node of few documents is compared exhaustively; larger ones branch again; what is still together after the
last level agrees in as many minwise values and is treated as a dense group: all members are compared with its first, and
then, in blocks, those pairs that are not connected yet. Christiani, Pagh, Sivertsen: "Scalable and Robust Set Similarity Join"
(2018). A compared pair counts if its signatures leave a chance and its full sets confirm it.

Documents with equal sets are one vertex from the start. What is asked for is connected classes, so of pairs inside a class
that is connected already no more are confirmed; links between classes are never left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import GOLD, WordHashes, dropped, keep_ids, kept_in_worker, mix, written
from .tokens import slices

#: Minwise values of a signature, trees, levels, documents of a node that is compared exhaustively, and the least share of equal
#: signature bytes at which a pair's sets are compared (for a pair of similarity 0.85 that is over four deviations away).
COORDINATES, TREES, LEVELS, SMALL, SKETCH = 64, 12, 4, 12, 0.65
#: Members of a block of a dense group.
BLOCK = 256
#: Members of a dense group that show its usual signature, about.
SAMPLE = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * GOLD) | np.uint64(1)


def shingles(text: str, hashes) -> np.ndarray:
    """The sorted set of 64-bit hashes of the 3-word shingles; of fewer words, the whole sequence as one; of none, empty."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes(words)
    if len(h) < 3:
        out = np.array([len(h)], np.uint64)
        for k in range(len(h)):
            out = mix(out * GOLD + h[k : k + 1])
        return out
    return np.unique(mix(mix(mix(h[:-2]) * GOLD + h[1:-1]) * GOLD + h[2:]))


def signature(found: np.ndarray) -> np.ndarray:
    """The least value of each of 64 hash functions over a set."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        x = found[at : at + 2048, None] * _SEEDS[None, :]
        x ^= x >> np.uint64(32)
        out = np.minimum(out, (x * GOLD).min(axis=0))
    return out


def _prepared(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), digest (of the set) and sig (64 four-byte values) of every document."""

    def run(batches):
        hashes = kept_in_worker(WordHashes)
        for batch in batches:
            for part in slices(batch):
                n, digests, sigs = [], [], []
                for text in part.column(1).to_pylist():
                    found = shingles(text, hashes)
                    n.append(len(found))
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                    sigs.append((signature(found) >> np.uint64(32)).astype("<u4").tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n", "digest", "sig"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n long, digest binary, sig binary")


def _children(rows: DataFrame, trees: int, threshold: float, root: bool) -> DataFrame:
    """rows (rep, sig, and node unless root): node, rep of the children that each row goes to."""
    two = 1 / threshold - 1  # the chance of a second coordinate: 1 / threshold are chosen in the mean

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u4").reshape(n, COORDINATES)
            rep = batch.column("rep").to_numpy(zero_copy_only=False)
            paths = [np.full(n, mix(np.array([t + 1], np.uint64))[0]) for t in range(trees)] if root else [batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)]
            for path in paths:
                seed = mix(path * GOLD)
                first = (seed % np.uint64(COORDINATES)).astype(np.int64)
                second = (first + 1 + (mix(seed) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
                also = (mix(seed ^ GOLD) >> np.uint64(11)).astype(np.float64) / 2**53 < two
                for at, own in ((first, np.ones(n, bool)), (second, also)):
                    node = mix(mix(path[own] + at[own].astype(np.uint64)) * GOLD + sig[np.flatnonzero(own), at[own]])
                    if len(node):
                        yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(rep[own])], names=["node", "rep"])

    return rows.mapInArrow(run, "node long, rep long")


def _counted(rows: DataFrame) -> DataFrame:
    """Rows of nodes with two members or more: node, rep, n (members) and low (the least)."""
    size = written(rows.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("low")).where("n > 1"), "sizes")
    out = written(rows.join(size, "node"), "nodes")
    dropped(size, release=False)
    return out


def _terminal(classes: DataFrame, trees: int, levels: int, threshold: float, small: int) -> DataFrame:
    """node, rep, n, low of the nodes in which the trees end. A child has the seed of its path, so the trees stay apart."""
    out, rows = [], _children(classes.select("rep", "sig"), trees, threshold, True)
    for level in range(1, levels + 1):
        rows = written(rows, "rows")
        found = _counted(rows)
        dropped(rows)
        large = found.where(F.col("n") > small)
        if level == levels:
            out.append(found)
            break
        out.append(found.where(F.col("n") <= small))
        if not large.limit(1).count():
            break
        rows = _children(large.select("node", "rep").join(classes.select("rep", "sig"), "rep"), trees, threshold, False)
    both = out[0]
    for x in out[1:]:
        both = both.unionByName(x)
    return both


def _alike(least: float):
    """Whether the share of equal values of two signatures is at least `least`."""
    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), "<u4").reshape(len(s), COORDINATES) for s in (a, b))
        return pd.Series((x == y).mean(axis=1) >= least)

    return alike


def _sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """rep and its full set (eight bytes for each shingle, ascending)."""

    def sets(batches):
        hashes = kept_in_worker(WordHashes)
        for batch in batches:
            for part in slices(batch):
                found = [shingles(t, hashes) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f.astype("<u8").tobytes() for f in found], pa.binary())], names=["rep", "found"])

    return written(keep_ids(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ids, "doc_id").mapInArrow(sets, "rep long, found binary"), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b of representatives) those with 100 * intersection >= percent * union of their full sets."""
    own = _sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs)

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(x) + len(y)
                low = min(len(x), len(y))
                if 100 * low < percent * (both - low):
                    keep.append(False)
                    continue
                merged = np.concatenate([x, y])
                merged.sort(kind="stable")
                common = int((merged[1:] == merged[:-1]).sum())
                keep.append(100 * common >= percent * (both - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(own.select(F.col("rep").alias("a"), F.col("found").alias("fa")), "a").join(own.select(F.col("rep").alias("b"), F.col("found").alias("fb")), "b")
    out = written(joined.select("a", "b", "fa", "fb").mapInArrow(check, "a long, b long"), "links")
    dropped(own)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of all ends of links (a, b), by alternating large-star and small-star steps (Kiveris et al.
    2014): each node's neighbours are tied to the least of them, until nothing changes. Every step is an aggregation and a join
    on the node, and each round's edges are written to the shared folder."""
    # the least neighbours are written before they are joined, so that a join's sides are plain shuffles, of which Spark can split the
    # partitions of hot nodes
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.join(first, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, "large")
        second = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        tied = large.join(second, "u")
        small = written(tied.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct(), "small")
        same = edges.count() == small.count() and not small.join(edges, ["u", "v"], "left_anti").limit(1).count()
        dropped(edges, first, large, second, release=False)
        edges = small
        if same:
            break
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    out = written(stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component")), "components")
    dropped(edges, release=False)
    return out


def _to_centre(dense: DataFrame, sig: DataFrame) -> DataFrame:
    """Pairs of each member of a dense group with its most central one: the member whose signature agrees most with the group's
    most frequent values, as about SAMPLE of its members have them. Copies made from one original all agree with that. (What is
    sampled is where to begin; no link depends on it.)"""

    @F.pandas_udf("binary")
    def usual(sigs: pd.Series) -> pd.Series:
        out = []
        for found in sigs:
            m = np.frombuffer(b"".join(found), "<u4").reshape(-1, COORDINATES)
            m = np.sort(m, axis=0)
            best, run = np.ones(COORDINATES, int), np.ones(COORDINATES, int)
            value = m[0].copy()
            for k in range(1, len(m)):
                run = np.where(m[k] == m[k - 1], run + 1, 1)
                value = np.where(run > best, m[k], value)
                best = np.maximum(best, run)
            out.append(value.astype("<u4").tobytes())
        return pd.Series(out, dtype=object)

    @F.pandas_udf("double")
    def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x, y = (np.frombuffer(b"".join(s), "<u4").reshape(len(s), COORDINATES) for s in (a, b))
        return pd.Series((x == y).mean(axis=1))

    rows = written(dense.join(sig, "rep"), "dense")
    some = rows.where(F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / SAMPLE)) == 0).groupBy("node").agg(F.collect_list("sig").alias("sigs")).select("node", usual("sigs").alias("usual"))
    # written between, so that each join has plain shuffles on both sides, of which Spark splits the partitions of large nodes, and
    # the aggregation begins in the tasks that read
    some = written(some, "usual")
    near = written(rows.join(some, "node").select("node", "rep", agreement("sig", "usual").alias("share")), "near")
    centre = written(near.groupBy("node").agg(F.max_by("rep", F.struct("share", -F.col("rep"))).alias("centre")), "centres")
    out = written(near.join(centre, "node").where("rep != centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")), "star")
    dropped(rows, some, near, centre, release=False)
    return out


def _mixed(nodes: DataFrame) -> DataFrame:
    """Rows of the nodes that hold several components."""
    mixed = nodes.groupBy("node").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("node")
    mixed = written(mixed, "mixed")
    out = written(nodes.join(mixed, "node", "left_semi"), "mixed")
    dropped(mixed, release=False)
    return out


def _of_small(rows: DataFrame, sig: DataFrame, small: int) -> DataFrame:
    """Pairs (a, b) with likely signatures of members of one small node that are in different components."""
    few = rows.where(F.col("n") <= small).select("node", "rep", "comp")
    other = few.select("node", F.col("rep").alias("b"), F.col("comp").alias("cb"))
    pairs = few.join(other, "node").where("rep < b and comp != cb").select(F.col("rep").alias("a"), "b").distinct()
    return _likely(pairs, sig)


def _likely(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    pairs = pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
    return pairs.where(_alike(SKETCH)("sa", "sb")).select("a", "b")


def intersections(xs: list[np.ndarray], ys: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each of xs with each of ys (sorted sets), by products of 0-1 matrices over the elements that
    both sides have, `width` at a time."""
    out = np.zeros((len(xs), len(ys)), np.float32)
    common = np.intersect1d(np.unique(np.concatenate(xs)), np.unique(np.concatenate(ys)), assume_unique=True)
    if not len(common):
        return out

    def places(sets):
        found = []
        for s in sets:
            at = np.minimum(np.searchsorted(common, s), len(common) - 1)
            found.append(at[common[at] == s])
        return found

    px, py = places(xs), places(ys)
    for low in range(0, len(common), width):
        sides = []
        for found in (px, py):
            m = np.zeros((len(found), min(width, len(common) - low)), np.float32)
            for k, at in enumerate(found):
                m[k, at[np.searchsorted(at, low) : np.searchsorted(at, low + width)] - low] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _of_dense(rows: DataFrame, docs: DataFrame, small: int, percent: int) -> DataFrame | None:
    """Links (a, b) between different components of dense groups: the members outside a group's largest component are compared, by
    their full sets, with all members, in blocks, so that no task gets a group as a whole. Of a block's links between two
    components one is given."""
    dense = rows.where(F.col("n") > small)
    if not dense.limit(1).count():
        return None
    most = dense.groupBy("node", "comp").agg(F.count("*").alias("c")).groupBy("node").agg(F.max_by("comp", F.struct("c", -F.col("comp"))).alias("main"), F.sum("c").alias("size"), F.max("c").alias("c"))
    most = written(most.select("node", "main", F.ceil(F.col("size") / BLOCK).alias("bi"), F.ceil((F.col("size") - F.col("c")) / BLOCK).alias("bj")), "groups")
    members = written(dense.join(most, "node").select("node", "rep", "comp", F.col("comp") != F.col("main"), "bi", "bj").toDF("node", "rep", "comp", "rest", "bi", "bj"), "dense")
    own = F.struct("rep", "comp")
    # a group (node, i, j): members of block i, and of block j of those that are not in the largest component
    left = members.select("node", F.pmod(F.xxhash64("rep"), "bi").alias("i"), F.explode(F.sequence(F.lit(0), F.col("bj") - 1)).alias("j"), F.lit(True).alias("all"), own.alias("m"))
    right = members.where("rest").select("node", F.explode(F.sequence(F.lit(0), F.col("bi") - 1)).alias("i"), F.pmod(F.xxhash64("rep"), "bj").alias("j"), F.lit(False).alias("all"), own.alias("m"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["all"] == side].sort_values("rep") for side in (True, False)]
        if not len(sides[0]) or not len(sides[1]):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        xs, ys = ([np.frombuffer(f, "<u8") for f in side["found"]] for side in sides)
        common = intersections(xs, ys)
        total = np.array([len(x) for x in xs])[:, None] + np.array([len(y) for y in ys])[None, :]
        cx, cy = (side["comp"].to_numpy() for side in sides)
        i, j = np.nonzero((100 * common >= percent * (total - common)) & (cx[:, None] != cy[None, :]))
        if not len(i):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        first = np.unique(np.stack([cx[i], cy[j]]), axis=1, return_index=True)[1]
        a, b = sides[0]["rep"].to_numpy()[i[first]], sides[1]["rep"].to_numpy()[j[first]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}, dtype="int64")

    sets = _sets(members.select(F.col("rep").alias("doc_id")).distinct(), docs)
    groups = left.unionByName(right).select("node", "i", "j", "all", "m.rep", "m.comp").join(sets, "rep")
    out = written(groups.groupBy("node", "i", "j").applyInPandas(compare, "a long, b long").distinct(), "links")
    dropped(most, members, sets)
    return out


def near_duplicates(docs: DataFrame, percent: int = 85, trees: int = TREES, levels: int = LEVELS, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own included), kept (doc_id = component_id).

    Letters A-Z are lower-cased; words are runs of characters other than ASCII white space. Null text or no words: an empty set,
    linked with nothing. Rows of null doc_id: linked with nothing, component null, kept. Of several rows of one doc_id the
    sets of all count, and all share a component; n_shingles is each row's own. With the defaults a link of similarity 0.85 is missed with a
    chance of about 1 in 10,000, and a class only if no other path connects it."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = written(_prepared(own), "sets")
    real = table.where("doc_id is not null")
    classes = written(real.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig")), "classes")
    copies = real.where("n > 0").join(classes.select("digest", "rep"), "digest").where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    named = classes.select("rep", "sig").dropDuplicates(["rep"])
    ends = written(_terminal(classes, trees, levels, percent / 100, small), "ends")
    known = own.where("doc_id is not null")
    sig = named.select("rep", "sig")
    star = ends.where("rep != low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    star = star.unionByName(_to_centre(ends.where(F.col("n") > small).select("node", "rep", "n"), sig)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    likely = written(_likely(star, sig), "stars")
    links = _confirmed(likely, known, percent)
    first = components(links)
    nodes = _mixed(ends.join(first.select(F.col("node").alias("rep"), "component"), "rep", "left").select("node", "rep", "n", F.coalesce("component", "rep").alias("comp")))
    residual = written(_of_small(nodes, sig, small), "residual")
    more = _confirmed(residual, known, percent)
    dense = _of_dense(nodes, known, small, percent)
    every = links.unionByName(copies).unionByName(more)
    found = components(every if dense is None else every.unionByName(dense))
    dropped(classes, ends, likely, links, first, nodes, residual, more, *([] if dense is None else [dense]))
    out = table.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i+2], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS id, a AS to_id FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.to_id),
c AS (SELECT id, min(to_id) AS component FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, w.doc_id) AS component_id, w.doc_id = coalesce(c.component, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.id = w.doc_id
"""
