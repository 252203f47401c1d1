"""Points that cover a set, nearest centres, mean vectors and crowded images, held against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import annotations as ann, groups, rounds


def table(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")


def units(n, dims, seed):
    v = np.random.default_rng(seed).normal(size=(n, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def radius(v, ids):
    return np.sqrt(np.maximum(0, 2 - 2 * (v @ v[ids].T).max(axis=1))).max()


def test_farthest_first_is_coreset(spark):
    v = units(300, 6, 1)
    assert groups.farthest_first(v, 9) == [r.id for r in groups.coreset(table(spark, v), 9).orderBy("rank").collect()]
    assert groups.farthest_first(v[:3], 9)[0] == 0 and len(set(groups.farthest_first(v[:3], 9))) == 3


@pytest.mark.parametrize(("k", "last"), [(5, 40), (40, 200), (40, 5000)])
def test_composed_coreset_keeps_its_bound(spark, k, last):
    v = units(2500, 5, 2)
    got = groups.composed_coreset(table(spark, v), k, last=last).orderBy("rank").collect()
    ids = [r.id for r in got]
    assert [r.rank for r in got] == list(range(k)) and len(set(ids)) == k
    # the farthest-first radius is at most twice the best one, and at least as large as it: 2 (r + 1) of it holds for r rounds, here up to 4
    assert radius(v, ids) <= 2 * 5 * radius(v, groups.farthest_first(v, k))
    assert radius(v, ids) <= 1.6 * radius(v, groups.farthest_first(v, k))  # what is measured
    if last >= 2500:
        assert ids == groups.farthest_first(v, k)


def test_composed_coreset_finds_planted_clusters(spark):
    centres = units(12, 16, 3)
    v = np.repeat(centres, 150, axis=0) + np.random.default_rng(4).normal(size=(1800, 16)) * 0.01
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = [r.id for r in groups.composed_coreset(table(spark, v), 12, last=100).collect()]
    assert {i // 150 for i in ids} == set(range(12))


def test_jobs_of_composed_clusters_do_not_grow(spark):
    v = table(spark, units(900, 8, 5)).cache()
    jobs = []
    for k in (20, 200):
        spark.sparkContext.setJobGroup(f"k{k}", "")
        groups.composed_coreset(v, k, last=100).count()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"k{k}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[1] <= jobs[0] < 40
    few = groups.coreset_clusters(v, 0.9, composed=True).collect()
    assert len(few) == 900 and len({r.cluster for r in few}) == int(900 * (1 - 0.9))


def test_few_rows(spark):
    v = table(spark, units(3, 4, 6))
    assert groups.composed_coreset(v, 9).count() == 3 and groups.composed_coreset(v.limit(0), 2).count() == 0


@pytest.mark.parametrize("most", [10_000, 7])
def test_nearest_in_slices(spark, most):
    v, c = units(500, 9, 7), units(40, 9, 8)
    c[11] = c[3]  # a tie: the first stays
    centres = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "rank int, v array<double>")
    far = np.round(1 - v @ c.T, 9)
    got = groups.nearest(table(spark, v), centres, most).orderBy("id").collect()
    assert [r.centre for r in got] == far.argmin(axis=1).tolist() and np.allclose([r.distance for r in got], far.min(axis=1), atol=2e-9)


def test_mean_vectors(spark, monkeypatch):
    monkeypatch.setattr(groups, "OPEN_SUMS", 2)
    v = units(400, 5, 9)
    rows = table(spark, v).withColumn("a", (F.col("id") % 7).cast("int")).withColumn("b", F.when(F.col("id") % 2 == 0, "even"))
    rows = rows.unionByName(spark.createDataFrame([(999, None, 1, None)], rows.schema)).repartition(6)
    got = {(r.a, r.b): r.mu for r in groups.mean_vector(rows, "a", "b").collect()}
    assert len(got) == 14
    for (a, b), mu in got.items():
        own = [i for i in range(400) if i % 7 == a and (i % 2 == 0) == (b == "even")]
        assert np.allclose(mu, v[own].mean(axis=0))
    assert np.allclose(groups.mean_vector(rows).first().mu, v.mean(axis=0)) and groups.mean_vector(rows.limit(0), "a").count() == 0


def iou_of(b):
    x1, y1, x2, y2 = b.T
    w = np.clip(np.minimum(x2[:, None], x2) - np.maximum(x1[:, None], x1), 0, None)
    h = np.clip(np.minimum(y2[:, None], y2) - np.maximum(y1[:, None], y1), 0, None)
    area = (x2 - x1) * (y2 - y1)
    with np.errstate(invalid="ignore"):
        return w * h / (area[:, None] + area - w * h)


@pytest.mark.parametrize("threshold", [0.05, 0.45, 0.9])
def test_overlapping_boxes_by_cells(spark, threshold):
    deal = np.random.default_rng(10)
    at, size = deal.uniform(-50, 50, (700, 2)), np.exp(deal.uniform(-3, 4, (700, 2)))
    size[:20], size[20:60] = 0, 16.0  # no area, and sides of a cell's own
    at[20:40] = np.round(at[20:40] / 16) * 16
    b = np.hstack([at, at + size])
    rows = spark.createDataFrame([(int(i % 2), *map(float, x), i) for i, x in enumerate(b)], "img int, x1 double, y1 double, x2 double, y2 double, n long")
    over = iou_of(b)
    want = {(i, j) for i in range(700) for j in range(i + 1, 700) if i % 2 == j % 2 and over[i, j] > threshold}
    got = [tuple(r) for r in ann.overlapping(rows, "n", threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_one_image_of_200_000_boxes(spark):
    side = "1.2e0 + id % 5 * 0.1e0"
    rows = spark.range(200_000).selectExpr("1 as img", "(id % 447) + (id * 7919 % 97) / 200.0e0 as x1", "floor(id / 447) + (id * 104729 % 89) / 200.0e0 as y1", f"{side} as side", "0.3e0 + (id * 31 % 7000) / 10000.0e0 as conf", "cast(id as int) as ord")
    rows = rows.selectExpr("img", "x1", "y1", "x1 + side as x2", "y1 + side as y2", "conf", "ord").cache()
    many = {r.ord for r in ann.suppressed(rows, threshold=0.3).select("ord").collect()}
    # plainly: boxes reach no farther than two cells
    b = np.array([tuple(r) for r in rows.select("x1", "y1", "x2", "y2", "conf", "ord").collect()])
    b = b[np.lexsort((b[:, 5], -b[:, 4]))]
    cells, kept = {}, set()
    for x1, y1, x2, y2, _, o in b.tolist():
        near = [k for i in range(-2, 3) for j in range(-2, 3) for k in cells.get((int(x1) + i, int(y1) + j), ())]
        clash = False
        for p1, q1, p2, q2 in near:
            w, h = min(x2, p2) - max(x1, p1), min(y2, q2) - max(y1, q1)
            if w > 0 and h > 0 and w * h > 0.3 * ((x2 - x1) * (y2 - y1) + (p2 - p1) * (q2 - q1) - w * h):
                clash = True
                break
        if not clash:
            kept.add(int(o))
            cells.setdefault((int(x1), int(y1)), []).append((x1, y1, x2, y2))
    assert many == kept and len(kept) < 200_000


def test_settings_of_unknown_machines(spark):
    rows = spark.createDataFrame([(None, None, "none"), (True, None, "transfer")], "gpu boolean, gb int, strategy string")
    got = {tuple(r) for r in rounds.training_settings(rows).select("epochs", "frozen", "backend", "dims").collect()}
    assert got == {(None, None, "mobilenet_v3", 576), (40, 10, "resnet50", 2048)}


def test_coreset_finds_many_points_a_job(spark):
    v = units(900, 8, 7)
    v[100:140] = v[7]  # copies: ties go to the lowest id
    rows = table(spark, v).cache()
    want = groups.farthest_first(v, 400)
    for most in (8192, 90):  # all rows handed on, and a tenth of them
        spark.sparkContext.setJobGroup(f"coreset{most}", "")
        assert [r.id for r in groups.coreset(rows, 400, size=200, most=most).orderBy("rank").collect()] == want
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"coreset{most}")) < 200
    spark.sparkContext.setJobGroup("", "")


def test_linkage_in_rounds_is_that_of_one_task(spark):
    v = units(400, 6, 9)
    v[50:90] = v[3]  # copies
    v[395:398] = 0
    rows = table(spark, v)
    one, many = (sorted((r.j, round(r.height, 9)) for r in groups.linked(rows, 0.9, few).collect()) for few in (1000, 200))
    assert [h for _, h in sorted(one, key=lambda x: x[1])] == [h for _, h in sorted(many, key=lambda x: x[1])]
    assert len({j for j, _ in many}) == len(many)
    one, many = ([r.cluster for r in groups.average_linkage(rows, 0.4, few).orderBy("id").collect()] for few in (1000, 200))
    assert one == many and len(set(many[50:90])) == 1 and len(set(many[395:398])) == 3


def test_linkage_has_no_limit(spark):
    """More than the 20,000 rows that raised an error, of 30 vectors."""
    v = units(30, 64, 10)
    rows = spark.range(21_000).select("id", F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in v])[(F.col("id") % 30).cast("int")].alias("v"))
    got = groups.average_linkage(rows, 0.99)
    assert got.where("cluster != id % 30").count() == 0 and got.count() == 21_000


def curve(n):
    """Unit vectors on an arc whose gaps grow: each one's nearest is the one before, so only one pair at a time is mutually nearest."""
    at = np.cumsum(np.linspace(1e-4, 8e-3, n))
    return np.stack([np.cos(at), np.sin(at), 0 * at], axis=1)


@pytest.mark.parametrize("below", [0.001, 0.1, 0.6, float("inf")])
def test_merges_of_pairs_are_those_of_all(below):
    for v in (units(300, 3, 1), units(300, 6, 2), curve(300)):
        least = max(1 - below, -1.1)
        want = groups.merges(v, None, below)
        a, b = np.nonzero(np.triu(v @ v.T >= least, 1))
        s = np.einsum("ij,ij->i", v[a], v[b])
        chains = groups.chained(v.copy(), np.ones(300), a, b, least, below)
        for i, j, height in (groups.merges_of_edges(v.copy(), np.ones(300), a, b, s, least, below), groups.merges_in_levels(v.copy(), np.ones(300), below, 20), [np.array(x, k) for x, k in zip(zip(*chains), (int, int, float))] or [a[:0]] * 3):
            assert np.allclose(sorted(height), sorted(h for _, _, h in want))
            assert (groups.owners(300, i, j) == groups.owners(300, *(np.array([m[k] for m in want], int) for k in (0, 1)))).all()


@pytest.mark.parametrize("below, most, room", [(0.9, 4_000_000, 1 << 30), (0.9, 300, 1 << 30), (0.9, 4_000_000, 5000), (float("inf"), 2000, 1 << 30)])
def test_linkage_in_levels_keeps_a_task_in_bounds(spark, below, most, room):
    rows = table(spark, units(400, 6, 11)).cache()
    one, many = (groups.linked(rows, below, *few).collect() for few in ((1000,), (150, most, room)))
    assert np.allclose(sorted(r.height for r in one), sorted(r.height for r in many)) and {r.j for r in one} == {r.j for r in many}


def test_linkage_takes_few_jobs_where_few_are_mutually_nearest(spark):
    """By rounds of mutually nearest pairs alone these were more than a hundred rounds of a dozen jobs."""
    rows = table(spark, curve(300)).cache()
    want = groups.merges(curve(300), None, 0.05)
    spark.sparkContext.setJobGroup("linkage", "")
    got = groups.linked(rows, 0.05, 20).collect()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("linkage")) < 250
    spark.sparkContext.setJobGroup("", "")
    assert np.allclose(sorted(r.height for r in got), sorted(h for _, _, h in want)) and {r.j for r in got} == {j for _, j, _ in want}
