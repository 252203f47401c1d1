"""Geometry of boxes as column expressions. YOLO form: centre and size as shares of the image; corners in pixels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def yolo_to_corners(cx, cy, w, h, width, height) -> list[Column]:
    """xmin, ymin, xmax, ymax, clamped to the image."""
    return [clamp((cx - w / 2) * width, 0.0, width), clamp((cy - h / 2) * height, 0.0, height), clamp((cx + w / 2) * width, 0.0, width), clamp((cy + h / 2) * height, 0.0, height)]


def corners_to_yolo(x1, y1, x2, y2, width, height) -> list[Column]:
    """From Pascal VOC corners; each value clamped to 0-1."""
    return [clamp(x, 0.0, 1.0) for x in ((x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height)]


def coco_to_yolo(x, y, w, h, width, height) -> list[Column]:
    return [clamp(v, 0.0, 1.0) for v in ((x + w / 2) / width, (y + h / 2) / height, w / width, h / height)]


def corners_to_centre(x1, y1, x2, y2, width, height) -> list[Column]:
    """From a detector's corners, as they are: centre and size as shares of the image, not clamped."""
    w, h = x2 - x1, y2 - y1
    return [(x1 + w / 2) / width, (y1 + h / 2) / height, w / width, h / height]


def detector_class(label: Column) -> Column:
    """The class id of a detector's label, whose first is the background; never below 0."""
    return F.greatest(label - 1, F.lit(0))


def yolo_to_rect(cx, cy, w, h, width, height) -> list[Column]:
    """Left, top, width and height in pixels, not clamped: what an editor draws."""
    return [cx * width - w * width / 2, cy * height - h * height / 2, w * width, h * height]


def rect_to_yolo(x, y, w, h, width, height) -> list[Column]:
    """From a drawn rectangle: corners are clamped first."""
    x1, y1 = clamp(x, 0.0, width), clamp(y, 0.0, height)
    x2, y2 = clamp(x + w, 0.0, width), clamp(y + h, 0.0, height)
    return [(x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height]


def letterbox(width, height, side: float = 640.0) -> list[Column]:
    """ratio, pad_x, pad_y with which an image is fitted into a square."""
    ratio = F.least(side / width, side / height)
    return [ratio, (side - F.bround(width * ratio)) / 2, (side - F.bround(height * ratio)) / 2]


def undo_letterbox(x, y, width, height, side: float = 640.0) -> list[Column]:
    ratio, px, py = letterbox(width, height, side)
    return [clamp((x - px) / ratio, 0.0, width), clamp((y - py) / ratio, 0.0, height)]


def iou(a: list[Column], b: list[Column]) -> Column:
    """Of two boxes given by corners; 0 where the union is empty."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def moved(x, y, w, h, dx, dy, width, height) -> list[Column]:
    """Moved, but kept inside the image."""
    return [clamp(x + dx, 0.0, width - w), clamp(y + dy, 0.0, height - h), w, h]


def scaled(x, y, w, h, factor: float) -> list[Column]:
    """Scaled about the centre (1.05 and 0.95 are the editor's steps)."""
    return [x + w * (1 - factor) / 2, y + h * (1 - factor) / 2, w * factor, h * factor]


def resized(x, y, w, h, corner: str, px, py, least: float = 5.0) -> list[Column]:
    """A corner (tl, tr, bl, br) dragged to a point; ignored unless both sides stay above `least` pixels."""
    x2, y2 = x + w, y + h
    left, top = ("l" in corner), ("t" in corner)
    nx, nw = (px, x2 - px) if left else (x, px - x)
    ny, nh = (py, y2 - py) if top else (y, py - y)
    ok = (nw > least) & (nh > least)
    return [F.when(ok, a).otherwise(b) for a, b in ((nx, x), (ny, y), (nw, w), (nh, h))]


def pasted(x, y, w, h, step: float = 20.0) -> list[Column]:
    return [x + step, y + step, w, h]


def nudged(x, y, w, h, px, py, step: float = 2.0) -> list[Column]:
    """The edge nearest to a point moved outwards by `step`."""
    gaps = [F.abs(px - x), F.abs(px - (x + w)), F.abs(py - y), F.abs(py - (y + h))]
    near = F.array_position(F.array(*gaps), F.array_min(F.array(*gaps)))
    return [F.when(near == 1, x - step).otherwise(x), F.when(near == 3, y - step).otherwise(y), F.when(near <= 2, w + step).otherwise(w), F.when(near >= 3, h + step).otherwise(h)]
