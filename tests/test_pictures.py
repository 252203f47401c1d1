"""Hashes of pictures against their definition, and the candidates of the scan."""

import numpy as np

from quarrymill.functions import pixels as px
from quarrymill.operators import groups, pictures
from quarrymill.sources import files

from .test_files import png


def picture(seed=0, shape=(200, 150)):
    rng = np.random.default_rng(seed)
    return np.kron(rng.integers(0, 255, (shape[0] // 10, shape[1] // 10)), np.ones((10, 10))).astype(float)


def test_boxes_by_definition():
    x = picture()[:37, :23]
    for width in (1, 2, 3, 4, 7):
        got = px.box_blurred(x, width)
        ahead = (width + 2) // 2 - 1
        for c in range(x.shape[1]):
            own = [k for k in range(c + ahead - width + 1, c + ahead + 1) if 0 <= k < x.shape[1]]
            assert np.allclose(got[:, c], x[:, own].mean(axis=1))


def test_small_picture_by_definition():
    x = picture(1, (330, 260))
    y = x
    for _ in range(2):
        y = px.box_blurred(y, -(-y.shape[1] // 128))
        y = px.box_blurred(y.T, -(-y.shape[0] // 128)).T
    want = [[y[int((r + 0.5) * 330 / 64), int((c + 0.5) * 260 / 64)] for c in range(64)] for r in range(64)]
    assert np.allclose(px.blurred_small(x), want)
    assert px.blurred_small(np.full((5, 9), 3.0)).shape == (64, 64)


def test_transforms_of_eight_orientations_by_definition():
    """Each of the eight derived transforms is that of the turned picture, summed term by term."""
    small = px.blurred_small(picture(2))
    k, j = np.arange(1, 17), np.arange(64)
    wave = np.cos(np.pi / 128 * k[:, None] * (2 * j[None, :] + 1))
    for turned, got in zip(px.oriented(small), px.turned_transforms(px.wide_transform(small))):
        for u, v in ((0, 0), (1, 4), (15, 3), (8, 15)):
            want = (2 / 64) * sum(turned[r, c] * wave[u, r] * wave[v, c] for r in range(64) for c in range(64))
            assert abs(got[u, v] - want) < 1e-5
        bits = (got > np.median(got)).ravel()
        assert 120 <= bits.sum() <= 136
    hashes, quality = px.wide_hashes(picture(2))
    assert len(hashes) == 8 and quality == 100 == px.wide_hash(picture(2))[1]
    assert px.wide_hashes(np.full((90, 90), 8.0))[1] == 0 and not np.concatenate(px.wide_hashes(np.full((90, 90), 8.0))[0]).any()


def test_quality_by_definition():
    small = px.blurred_small(picture(3)) / 40
    total = 0
    for r in range(64):
        for c in range(64):
            total += abs(int((small[r, c] - small[r + 1, c]) * 100 / 255)) if r < 63 else 0
            total += abs(int((small[r, c] - small[r, c + 1]) * 100 / 255)) if c < 63 else 0
    assert px.wide_quality(small) == min(100, total // 90)


def test_turned_pictures_have_turned_hashes():
    x = picture(4, (640, 640))
    own = px.wide_hashes(x)[0]
    for k, y in enumerate(px.oriented(x)):
        assert (px.wide_hashes(y)[0][0] != own[k]).sum() <= 24
    other = px.wide_hashes(picture(5, (640, 640)))[0]
    assert min((a != b).sum() for a in own for b in other) > 70
    six = px.turned_hashes(x)
    assert len(six) == 6 and all((px.perceptual_hash(y) == h).all() for y, h in zip(px.oriented(x)[:6], six))


def test_flat_pictures_are_few_candidates(spark, tmp_path):
    """A hundred flat pictures of five grays in several sizes: five classes, and pairs of neighbouring grays alone."""
    for k in range(100):
        (tmp_path / f"{k:03d}.png").write_bytes(png(np.full((20 + k, 30), 40 * (k % 5))))
    found = files.pixels(spark, str(tmp_path))
    d = found.select("origin", pictures.described(pictures.F.struct(*found.columns), 5).alias("d")).select("origin", "d.*")
    rows = groups.written(groups.numbered(d, "id", "origin"))
    classes = {r.id: r["class"] for r in pictures.classes(rows).collect()}
    assert classes == {k: k % 5 for k in range(100)}
    assert pictures.candidates(rows).count() == 100 * 99 // 2  # each pair once, where all are asked for
    assert pictures.candidates(rows, 19.0).count() == 5 * (20 * 19 // 2)
    told = []
    got = pictures.scan(spark, str(tmp_path), told=lambda *x: told.append(x)).collect()
    kept = {}
    for r in got:
        kept.setdefault((r.layer, r.group_id), []).append(r)
    assert [p for _, _, p in told] == ["bytes", "hashes", "pairs", "pixels"] and told[1][0] == 100 and told[2][0] == 0
    assert len(kept) == 5 and all(k[0] == "L2" and len(v) == 20 for k, v in kept.items())
    assert not pictures.scan(spark, str(tmp_path), least_quality=1).count()


def test_candidates_equal_all_pairs(spark):
    """Hashes at all distances in all orientations: those within five bits, as by comparing everything."""
    rng = np.random.default_rng(9)
    base = [[rng.integers(0, 2, 256).astype(bool) for _ in range(8)] for _ in range(6)]
    sets = []
    for b in base:
        for flips in (0, 1, 3, 5, 6, 9):
            own = [h.copy() for h in b]
            own[int(rng.integers(8))][rng.choice(256, flips, replace=False)] ^= True
            others = [rng.integers(0, 2, 256).astype(bool) for _ in range(7)]
            sets.append([*others[:3], own[int(rng.integers(8))], *others[3:]])
    bands = groups.band_bounds(5, 256)
    packed = lambda h: np.packbits(h, bitorder="little").view("<i8").tolist()
    key = lambda k, h, a, n: hash((k, h[a : a + n].tobytes())) % (1 << 60)
    rows = spark.createDataFrame([(i, [w for h in own for w in packed(h)], [x for k, (a, n) in enumerate(bands) for x in sorted({key(k, h, a, n) for h in own})], 0.0) for i, own in enumerate(sets)], "id long, words array<long>, keys array<long>, mean double")
    want = []
    for i, x in enumerate(sets):
        for j in range(i + 1, len(sets)):
            best = min((int((p != q).sum()), a, b) for a, p in enumerate(x) for b, q in enumerate(sets[j]))
            if best[0] <= 5:
                want.append((i, j, *best))
    assert want and sorted(tuple(r) for r in pictures.hash_pairs(rows, 5).collect()) == want
