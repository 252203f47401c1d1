"""Models as plug-ins: embeddings, detections and training loops over tables. None is shipped; a factory is called in the workers."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.boxes import corners_to_centre, detector_class, undo_letterbox
from ..functions.pixels import shrunk
from .rounds import BACKENDS

#: Means and deviations (RGB) by which pictures are normalised, their side, and pictures of a batch.
MEANS, DEVIATIONS, SIDE, BATCH = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225), 224, 32
#: The rate of classic training, the epochs after which it falls, and the factor.
RATE, FALLS_AFTER, FACTOR = 0.005, 3, 0.1
DETECTIONS = "path string, ord int, label int, x1 double, y1 double, x2 double, y2 double, conf double"


class Embedder(Protocol):
    """Vectors of a batch: an array (n, 3, SIDE, SIDE) of normalised RGB to (n, dim)."""

    def __call__(self, pictures: np.ndarray) -> np.ndarray: ...


class Detector(Protocol):
    """Boxes of one picture (height, width, 3; RGB, 0-255): rows of label (1 is the first class), x1, y1, x2, y2 in pixels, conf."""

    def __call__(self, picture: np.ndarray, prompt: str | None) -> np.ndarray: ...


_FACTORIES: dict[str, tuple[Callable[[], Embedder], int]] = {}


def register(name: str, factory: Callable[[], Embedder], dim: int | None = None) -> None:
    """Makes a backend known by a name. dim: of its vectors; of the BACKENDS their own."""
    dim = BACKENDS.get(name) if dim is None else dim
    if not dim:
        raise ValueError(f"the dimension of {name} is needed")
    _FACTORIES[name] = factory, dim


def backend(name: str) -> tuple[Callable[[], Embedder], int]:
    if name not in _FACTORIES:
        raise ValueError(f"no backend {name}: register() one of {', '.join(BACKENDS)} or another")
    return _FACTORIES[name]


def rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Of the bytes of Spark's image source (BGR, BGRA or gray)."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[..., 2::-1]


def prepared(picture: np.ndarray, side: int = SIDE) -> np.ndarray:
    """(3, side, side), normalised."""
    return np.stack([(shrunk(picture[..., c].astype(float), side) / 255 - MEANS[c]) / DEVIATIONS[c] for c in range(3)]).astype(np.float32)


def embedded(images: DataFrame, name: str, batch: int = BATCH) -> DataFrame:
    """path, v (of length 1), dim of images (path, height, width, nChannels, data, as the image source has them); v is null for those
    that can't be read. A model is made once a task; memory is that of one batch of pictures."""
    factory, dim = backend(name)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in parts:
            for at in range(0, len(pdf), batch):
                own = pdf.iloc[at : at + batch]
                ok = (own["height"].fillna(-1) > 0).to_numpy()
                vectors: list = [None] * len(own)
                if ok.any():
                    model = model or factory()
                    made = np.asarray(model(np.stack([prepared(rgb(r.data, int(r.height), int(r.width), int(r.nChannels))) for r in own[ok].itertuples()])), float)
                    if made.shape != (ok.sum(), dim):
                        raise ValueError(f"{name} gave {made.shape}, not {(int(ok.sum()), dim)}")
                    made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-8)
                    for k, v in zip(np.flatnonzero(ok), made):
                        vectors[k] = v.tolist()
                yield pd.DataFrame({"path": own["path"].to_numpy(), "v": vectors, "dim": dim})

    return images.select("path", "height", "width", "nChannels", "data").mapInPandas(run, "path string, v array<double>, dim int")


def detected(images: DataFrame, factory: Callable[[], Detector], confidence: float = 0.5, prompt: str | None = None) -> DataFrame:
    """path, ord, cls_id, cx, cy, w, h, conf of what a detector finds above a confidence in images (as embedded() takes them)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in parts:
            for r in pdf.itertuples():
                if r.height is None or not r.height > 0:
                    continue
                model = model or factory()
                found = np.asarray(model(rgb(r.data, int(r.height), int(r.width), int(r.nChannels)), prompt), float).reshape(-1, 6)
                yield pd.DataFrame({"path": r.path, "ord": np.arange(len(found), dtype="int32"), "label": found[:, 0].astype("int32"), **{c: found[:, k] for k, c in enumerate(("x1", "y1", "x2", "y2", "conf"), 1)}})

    boxes = images.select("path", "height", "width", "nChannels", "data").mapInPandas(run, DETECTIONS).where(F.col("conf") > confidence)
    sizes = images.select("path", "height", "width")
    cells = corners_to_centre(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.col("width"), F.col("height"))
    return boxes.join(sizes, "path").select("path", "ord", detector_class(F.col("label")).alias("cls_id"), *[c.alias(n) for c, n in zip(cells, ("cx", "cy", "w", "h"))], "conf")


def anchors(raw: DataFrame, side: float = 640.0) -> DataFrame:
    """raw (img, ord, x, y, w, h in a square of `side`, scores, width and height of the image) with x1, y1, x2, y2 in the image's pixels:
    what best_class() and suppressed() take. The padding of the square is undone, and corners are kept inside."""
    size = [F.col("width"), F.col("height")]
    low = undo_letterbox(F.col("x") - F.col("w") / 2, F.col("y") - F.col("h") / 2, *size, side)
    high = undo_letterbox(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, *size, side)
    return raw.select("img", "ord", "scores", "width", "height", low[0].alias("x1"), low[1].alias("y1"), high[0].alias("x2"), high[1].alias("y2"))


def learning_rate(epoch: int, start: float = RATE, after: int = FALLS_AFTER, factor: float = FACTOR) -> float:
    """Of an epoch from 0: it falls by the factor every few epochs."""
    return start * factor ** (epoch // after)


class Messages:
    """Progress messages of a run, as JSON files that streaming.progress reads: each is written whole under another name first."""

    def __init__(self, folder: str, run: str):
        self.folder, self.run, self.n = folder, run, 0
        os.makedirs(folder, exist_ok=True)

    def put(self, status: str, **more) -> None:
        name = f"{self.run}-{self.n:06d}-{uuid.uuid4().hex}.json"
        with open(temp := f"{self.folder}/.{name}", "w", encoding="utf-8") as out:
            out.write(json.dumps({"run": self.run, "status": status, "ts": time.strftime("%Y-%m-%dT%H:%M:%S"), **more}) + "\n")
        os.replace(temp, f"{self.folder}/{name}")
        self.n += 1


def trained(epoch: Callable[[int, float], tuple[float, float]], epochs: int, messages: Messages, stop: Callable[[], bool] = lambda: False, callback: Callable[[int, int, str], None] | None = None) -> str:
    """Runs a training loop on the driver: epoch(k, rate) trains one epoch and returns its mean loss and mAP50. Sends start, a step for
    each epoch, and success, error (with its text) or stopped; stop() is asked before each epoch. callback(done, all, phase) is told
    as well. Returns the last status."""
    messages.put("start", total=epochs)
    try:
        for k in range(epochs):
            if stop():
                messages.put("stopped", epoch=k, total=epochs)
                return "stopped"
            loss, score = epoch(k, learning_rate(k))
            messages.put("step", epoch=k + 1, total=epochs, map50=score, loss=loss)
            if callback:
                callback(k + 1, epochs, "train")
    except Exception as e:  # what goes wrong in a plug-in is told, not raised
        messages.put("error", text=str(e))
        return "error"
    messages.put("success", epoch=epochs, total=epochs)
    return "success"
