"""Gray images as numpy arrays: resizing, perceptual hashes, differences, sharpness; and their vectorised column functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luminance of the bytes of Spark's image source (BGR or gray)."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return x[..., 0] if channels == 1 else x[..., 2] * 0.299 + x[..., 1] * 0.587 + x[..., 0] * 0.114


def exif_orientation(data: bytes) -> int:
    """The orientation (1-8; 1: as it is) that a JPEG's EXIF block tells, 1 where there is none."""
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            tiff = data[at + 10 : at + 2 + size]
            order = "little" if tiff[:2] == b"II" else "big"
            number = lambda i, n: int.from_bytes(tiff[i : i + n], order)
            start = number(4, 4)
            for k in range(number(start, 2)):
                entry = start + 2 + 12 * k
                if number(entry, 2) == 0x0112:
                    value = number(entry + 8, 2)
                    return value if 1 <= value <= 8 else 1
            return 1
        if kind in (0xD9, 0xDA):  # the picture itself
            return 1
        at += 2 + size
    return 1


def upright(x: np.ndarray, orientation: int) -> np.ndarray:
    """A picture turned and mirrored as its EXIF orientation asks."""
    turned = {1: lambda: x, 2: lambda: x[:, ::-1], 3: lambda: x[::-1, ::-1], 4: lambda: x[::-1], 5: lambda: x.swapaxes(0, 1), 6: lambda: np.rot90(x, -1), 7: lambda: x.swapaxes(0, 1)[::-1, ::-1], 8: lambda: np.rot90(x)}
    return np.ascontiguousarray(turned[orientation]())


def resized(x: np.ndarray, side: int) -> np.ndarray:
    """Bilinear, with pixel centres aligned."""
    out = x
    for axis in (0, 1):
        n = out.shape[axis]
        at = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        high, share = np.minimum(low + 1, n - 1), at - low
        shape = (-1, 1) if axis == 0 else (1, -1)
        out = np.take(out, low, axis) * (1 - share).reshape(shape) + np.take(out, high, axis) * share.reshape(shape)
    return out


def dihedral(x: np.ndarray) -> list[np.ndarray]:
    f = np.fliplr(x)
    return [np.rot90(y, k) for y in (x, f) for k in range(4)]


#: What oriented() gives, in its order. Reasons of duplicates hold them.
LABELS = ("original", "rotated_90", "rotated_180", "rotated_270", "flip_vertical", "flip_horizontal", "rotated_90_flip_vertical", "rotated_90_flip_horizontal")


def oriented(x: np.ndarray) -> list[np.ndarray]:
    """As dihedral(), in the order of LABELS (turned counterclockwise, then flipped)."""
    y = np.rot90(x)
    return [x, y, np.rot90(x, 2), np.rot90(x, 3), np.flipud(x), np.fliplr(x), np.flipud(y), np.fliplr(y)]


def shrunk(x: np.ndarray, side: int) -> np.ndarray:
    """Bilinear, where made smaller over all pixels that a place covers (a triangle filter): no aliasing."""

    def weights(n: int) -> np.ndarray:
        scale = n / side
        w = np.maximum(0, 1 - np.abs((np.arange(n) + 0.5)[None, :] - ((np.arange(side) + 0.5) * scale)[:, None]) / max(1.0, scale))
        return w / w.sum(axis=1, keepdims=True)

    return weights(x.shape[0]) @ x @ weights(x.shape[1]).T


def cosine_transform(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))


def perceptual_hash(x: np.ndarray, side: int = 8) -> np.ndarray:
    """side * side bits: low frequencies of the 4 side x 4 side image above their median."""
    d = cosine_transform(4 * side)
    low = (d @ resized(x, 4 * side) @ d.T)[:side, :side]
    return (low > np.median(low)).ravel()


def turned_hashes(x: np.ndarray, side: int = 8) -> list[np.ndarray]:
    """perceptual_hash() of the six orientations of LABELS that don't both turn and flip, each from the picture as it is then."""
    return [perceptual_hash(y, side) for y in oriented(x)[:6]]


def box_blurred(x: np.ndarray, width: int) -> np.ndarray:
    """The mean of `width` neighbours along the last axis, of which (width + 2) // 2 - 1 come after a place; at the ends of those that
    are there."""
    n = x.shape[-1]
    ahead = (width + 2) // 2
    stop = np.minimum(np.arange(n) + ahead, n)
    start = np.maximum(np.arange(n) + ahead - width, 0)
    sums = np.concatenate([np.zeros((*x.shape[:-1], 1)), np.cumsum(x, axis=-1, dtype=np.float64)], axis=-1)
    return (sums[..., stop] - sums[..., start]) / (stop - start)


def blurred_small(x: np.ndarray, side: int = 64, passes: int = 2) -> np.ndarray:
    """side x side pixels of a gray picture: blurred by boxes twice along rows and columns (about a tent as wide as what a place stands
    for), then taken at the middle of each place."""
    for _ in range(passes):
        x = box_blurred(x, -(-x.shape[1] // (2 * side)))
        x = box_blurred(x.T, -(-x.shape[0] // (2 * side))).T
    row, column = (((np.arange(side) + 0.5) * n / side).astype(int) for n in x.shape)
    return x[np.ix_(row, column)]


def wide_transform(small: np.ndarray) -> np.ndarray:
    """Frequencies 1 to 16 of both axes of a 64 x 64 picture; what rounding leaves of a zero is none."""
    d = cosine_transform(64)[1:17] * np.sqrt(2 / 64)
    return np.round(d @ small @ d.T, 6)


def wide_quality(small: np.ndarray) -> int:
    """0 to 100: how much neighbours of a 64 x 64 picture differ, in hundredths of the range, whole ones, added up over 90."""
    steps = sum(int(np.abs(np.trunc(np.diff(small, axis=k) * 100 / 255)).sum()) for k in (0, 1))
    return min(100, steps // 90)


def turned_transforms(f: np.ndarray) -> list[np.ndarray]:
    """The transforms of the eight orientations of LABELS from that of the first: to mirror a picture changes the sign of its odd
    frequencies along that axis, to turn it transposes and mirrors."""
    sign = np.where(np.arange(1, len(f) + 1) % 2, -1.0, 1.0)
    down, across, t = sign[:, None], sign[None, :], f.T
    return [f, t * down, f * down * across, t * across, f * down, f * across, t, t * down * across]


def wide_hashes(x: np.ndarray) -> tuple[list[np.ndarray], int]:
    """256 bits for each orientation of LABELS, and the quality, of a gray picture: the published PDQ steps. A bit tells whether a
    frequency is above the median of all 256."""
    small = blurred_small(x)
    return [(f > np.median(f)).ravel() for f in turned_transforms(wide_transform(small))], wide_quality(small)


def wide_hash(x: np.ndarray) -> tuple[np.ndarray, int]:
    """The 256 bits of the picture as it is, and the quality."""
    hashes, quality = wide_hashes(x)
    return hashes[0], quality


def difference(a: np.ndarray, b: np.ndarray) -> float:
    """The least mean absolute difference over the eight orientations of b."""
    return float(min(np.abs(a - y).mean() for y in dihedral(b)))


def shifted_difference(a: np.ndarray, b: np.ndarray, reach: int = 2) -> float:
    """As difference(), over shifts of up to `reach` pixels, on what overlaps."""
    best, (h, w) = 255.0, a.shape
    for y in dihedral(b):
        for dy in range(-reach, reach + 1):
            for dx in range(-reach, reach + 1):
                p = a[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
                q = y[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
                best = min(best, float(np.abs(p - q).mean()))
    return best


def same_picture(a: np.ndarray, b: np.ndarray, most: float = 6.0, reach: int = 2, factor: float = 3.0) -> bool:
    """The gate after equal hashes: alike as they are, or, if nearly, after a small shift."""
    d = difference(a, b)
    return d <= most or (d <= most * factor and shifted_difference(a, b, reach) <= most)


def sharpness(x: np.ndarray) -> float:
    """Variance of the Laplacian, borders mirrored without the edge pixel."""
    p = np.pad(x, 1, mode="reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * x).var())


def _describe(image: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in image.itertuples():
        if r.height <= 0:
            out.append((None, None, None))
            continue
        x = gray(r.data, r.height, r.width, r.nChannels)
        out.append((perceptual_hash(x).tolist(), sharpness(x), resized(x, 128).astype(np.float32).ravel().tolist()))
    return pd.DataFrame(out, columns=["hash", "sharpness", "gray"])


def described(image: Column) -> Column:
    """Hash, sharpness and 128 x 128 gray of images as Spark's image source has them; null for unreadable ones."""
    return F.pandas_udf(_describe, "struct<hash:array<boolean>,sharpness:double,gray:array<float>>")(image)


def least_differences(a: Column, b: Column, side: int, reach: int = 0) -> Column:
    """difference() of gray images as arrays of side x side numbers, row by row; with reach shifted_difference()."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        picture = lambda v: np.asarray(v, float).reshape(side, side)
        return pd.Series([shifted_difference(picture(p), picture(q), reach) if reach else difference(picture(p), picture(q)) for p, q in zip(x, y)], dtype=float)

    return F.pandas_udf(run, "double")(a, b)
