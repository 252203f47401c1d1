"""COCO documents of any size, read and written by many tasks.

Reading: a file is cut into byte ranges. A first pass tells of each range how it changes what is open (a string, braces and brackets),
whatever was open before; from these few numbers follows what is open where each range begins. Then every range gives the objects
that begin in it, reading on past its end for the last one. No task holds more than a range and an object.

Writing: tasks write the objects of the three arrays in order as lines; the parts are then joined into one document as a stream.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.groups import shared_path
from .filesets import filesystem

#: Bytes of a range.
RANGE = 32 << 20
_QUOTE, _BACK, _OPEN, _CLOSE = 34, 92, (123, 91), (125, 93)


def _backslashes(file, at: int) -> int:
    """How many backslashes stand right before a place."""
    n = 0
    while at - n > 0:
        file.seek(at - n - 1)
        if file.read(1) != b"\\":
            break
        n += 1
    return n


def structure(data: np.ndarray, before: int, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(places, steps, inside): where outside of strings something opens (+1) or closes (-1), and whether a string is open at the end.
    before: backslashes right before the data; inside: whether a string is open at its beginning."""
    quote = np.flatnonzero(data == _QUOTE)
    plain = np.concatenate([[-1 - before], np.flatnonzero(data != _BACK)])
    run = quote - 1 - plain[np.searchsorted(plain, quote) - 1]
    quote = quote[run % 2 == 0]
    at = np.flatnonzero(np.isin(data, (*_OPEN, *_CLOSE)))
    within = (np.searchsorted(quote, at) + inside) % 2 == 1
    at = at[~within]
    return at, np.where(np.isin(data[at], _OPEN), 1, -1), bool((len(quote) + inside) % 2)


def _ranges(spark: SparkSession, size: int, step: int) -> DataFrame:
    n = max(1, -(-size // step))
    return spark.range(0, n, 1, min(n, 10_000))


def elements(spark: SparkSession, path: str, step: int = RANGE) -> DataFrame:
    """key, at, body: each object that is an element of an array which is a value of the document's own object; key: the array's; at:
    its place in the file; body: its text."""
    disk, own = filesystem(path)
    size = disk.get_file_info(own).size

    def loaded(file, start: int) -> np.ndarray:
        file.seek(start)
        return np.frombuffer(file.read(min(step, size - start)), np.uint8)

    def told(batches):
        with filesystem(path)[0].open_input_file(own) as file:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    before, data = _backslashes(file, k * step), loaded(file, k * step)
                    (_, out, odd), (_, within, _) = structure(data, before, False), structure(data, before, True)
                    yield pa.RecordBatch.from_pydict({"k": [k], "odd": [odd], "out": [int(out.sum())], "within": [int(within.sum())]})

    # a row for each range; what is open at its beginning follows from those before
    open_, state = [], (False, 0)
    for r in sorted(_ranges(spark, size, step).mapInArrow(told, "k long, odd boolean, out long, within long").collect()):
        open_.append(state)
        state = (state[0] != r.odd, state[1] + (r.within if state[0] else r.out))
    if state != (False, 0):
        raise ValueError("the document is cut off")

    def arrays(batches):
        with filesystem(path)[0].open_input_file(own) as file:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    start, data = k * step, loaded(file, k * step)
                    at, steps, _ = structure(data, _backslashes(file, start), open_[k][0])
                    depth = open_[k][1] + np.cumsum(steps)
                    for p in at[(steps == 1) & (depth == 2) & (data[at] == 91)].tolist():
                        file.seek(low := max(0, start + p - 4096))
                        head = file.read(start + p - low).rstrip().rstrip(b":").rstrip()
                        yield pa.RecordBatch.from_pydict({"at": [start + p], "key": [json.loads(b'"' + head[head[:-1].rfind(b'"') + 1 :])]})

    begun = sorted(_ranges(spark, size, step).mapInArrow(arrays, "at long, key string").limit(1001).collect())
    if len(begun) > 1000:
        raise ValueError("more than 1000 arrays in the document's own object")
    places, keys = np.array([r.at for r in begun], np.int64), [r.key for r in begun]

    def cut(batches):
        with filesystem(path)[0].open_input_file(own) as file:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    start, data = k * step, loaded(file, k * step)
                    inside, depth = open_[k]
                    at, steps, inside = structure(data, _backslashes(file, start), inside)
                    level = depth + np.cumsum(steps)
                    first = at[(steps == 1) & (level == 3) & (data[at] == 123)]
                    last = at[(steps == -1) & (level == 2) & (data[at] == 125)]
                    if not len(first):
                        continue
                    last = last[np.searchsorted(last, first[0]) :]
                    bodies = [data[a : b + 1].tobytes() for a, b in zip(first, last)]
                    if len(last) < len(first):  # the last one goes on
                        bodies.append(_rest(file, data[first[-1] :], start + len(data), inside, int(level[-1]), size))
                    key = [keys[i] for i in np.searchsorted(places, start + first) - 1]
                    for x in range(0, len(bodies), 4096):
                        yield pa.RecordBatch.from_arrays([pa.array(key[x : x + 4096]), pa.array(start + first[x : x + 4096], pa.int64()), pa.array(bodies[x : x + 4096], pa.binary()).cast(pa.string())], names=["key", "at", "body"])

    return _ranges(spark, size, step).mapInArrow(cut, "key string, at long, body string")


def _rest(file, begun: np.ndarray, at: int, inside: bool, depth: int, size: int) -> bytes:
    """An object that goes on past its range, read to its end."""
    out, step = [begun.tobytes()], 1 << 16
    while at < size:
        before = _backslashes(file, at)
        file.seek(at)
        data = np.frombuffer(file.read(step), np.uint8)
        places, steps, inside = structure(data, before, inside)
        level = depth + np.cumsum(steps)
        end = places[(steps == -1) & (level == 2)]
        if len(end):
            return b"".join([*out, data[: end[0] + 1].tobytes()])
        out.append(data.tobytes())
        depth, at = int(level[-1]) if len(level) else depth, at + len(data)
    raise ValueError("the document is cut off")


def save(tables: dict[str, DataFrame], path: str, order: str = "id") -> None:
    """Writes one JSON document whose arrays are the rows of the tables, by `order`. Tasks write the rows as lines, in ranges of `order`;
    then the files of lines are copied one after the other, a block at a time, for one document is one file. It appears by a
    rename, once whole."""
    disk, own = filesystem(path)
    with disk.open_output_stream(temp := f"{own}.{uuid.uuid4().hex}.new") as out:
        out.write(b"{")
        for n, (name, df) in enumerate(tables.items()):
            lines = df.repartitionByRange(order).sortWithinPartitions(order).select(F.to_json(F.struct(*df.columns)).alias("line"))
            lines.write.text(folder := shared_path(df.sparkSession))
            out.write((", " if n else "").encode() + json.dumps(name).encode() + b": [")
            parts, to = filesystem(folder)
            first = True
            for part in sorted(x.path for x in parts.get_file_info(fs.FileSelector(to)) if x.base_name.startswith("part-")):
                with parts.open_input_stream(part) as file:
                    held = b""
                    while block := file.read(1 << 20):
                        lines_, _, rest = (held + block).rpartition(b"\n")
                        if lines_:
                            out.write((b"" if first else b",\n") + lines_.replace(b"\n", b",\n"))
                            first = False
                        held = rest
            out.write(b"]")
            parts.delete_dir(to)
        out.write(b"}")
    disk.move(temp, own)
