"""Token ids in files of transposed and compressed blocks.

File: blocks one after the other, then the index (JSON, zstandard), its length as 8 bytes, and the magic. Each block of
ids holds `block` of them (the last one fewer) as planes: plane k of mode "byte" has byte k of each id, plane k of mode "bit"
has bit k of each, eight to a byte. Each plane is a zstandard frame of its own; planes that are all zero take no bytes. Blocks of
documents, among them, hold the ids and token counts of up to DOCS documents in file order, as longs. Index: mode, block size,
ids and documents in the file, for each block of ids its place, its planes' lengths and the crc32 of its ids, for each block of
documents its place, length, number of documents and of the ids before it, and which of them have no id.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import documents, fresh_dir, kept_in_worker, parts
from .tokens import ByteEncoder, slices, vocabulary

MAGIC = b"QMPLANE2"
#: Documents of a block of documents, and ids of a file, about: then the next one is begun.
DOCS, FILE_IDS = 1 << 15, 1 << 26


def planes(ids: np.ndarray, mode: str) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def unplanes(found: list[bytes], n: int, mode: str) -> np.ndarray:
    if mode == "byte":
        raw = np.empty((n, 4), np.uint8)
        for k, x in enumerate(found):
            raw[:, k] = np.frombuffer(x, np.uint8) if x else 0
        return raw.reshape(-1).view("<u4")
    bits = np.zeros((n, 32), np.uint8)
    for k, x in enumerate(found):
        if x:
            bits[:, k] = np.unpackbits(np.frombuffer(x, np.uint8), count=n)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """Writes ids to an open binary file, a block at a time; holds one block of ids, one of documents, and the index."""

    def __init__(self, out, block: int = 1 << 16, mode: str = "byte", level: int = 1):
        if mode not in ("byte", "bit"):
            raise ValueError("mode is byte or bit")
        self.out, self.block, self.mode = out, block, mode
        self.zip, self.left, self.at, self.ids = zstandard.ZstdCompressor(level=level), [], 0, 0
        self.waiting, self.blocks, self.docs, self.lists, self.n_docs, self.n_ids, self.listed = 0, [], [], [], 0, 0, 0

    def add(self, doc_id, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.n_docs, self.n_ids = self.n_docs + 1, self.n_ids + len(ids) // 4
        if len(self.docs) == DOCS:
            self._list()
        self.left.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 4 * self.block:
            data, self.left = b"".join(self.left), []
            full = len(data) // (4 * self.block) * 4 * self.block
            for at in range(0, full, 4 * self.block):
                self._flush(data[at : at + 4 * self.block])
            self.left, self.waiting = [data[full:]], len(data) - full

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def _list(self) -> None:
        own = np.array([(0 if d is None else d, n) for d, n in self.docs], "<i8")
        at = self.at
        self.lists.append([at, self._put(self.zip.compress(own.T.tobytes())), len(own), self.listed, [k for k, (d, _) in enumerate(self.docs) if d is None]])
        self.listed, self.docs = self.n_ids, []

    def _flush(self, data: bytes) -> None:
        found = [self.zip.compress(x) if x.strip(b"\0") else b"" for x in planes(np.frombuffer(data, "<u4"), self.mode)]
        self.blocks.append([self.at, [len(x) for x in found], zlib.crc32(data)])
        self._put(b"".join(found))
        self.ids += len(data) // 4

    def close(self) -> int:
        if self.waiting:
            self._flush(b"".join(self.left))
        if self.docs:
            self._list()
        index = self.zip.compress(json.dumps({"mode": self.mode, "block": self.block, "ids": self.ids, "n_docs": self.n_docs, "blocks": self.blocks, "lists": self.lists}).encode())
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)
        self.out.close()
        return self.ids


class Reader:
    """Reads documents of a file, in order or one by its number, a block at a time."""

    def __init__(self, file, size: int):
        file.seek(size - 16)
        tail = file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a file of id planes, or cut off")
        (n,) = struct.unpack("<Q", tail[:8])
        file.seek(size - 16 - n)
        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        self.__dict__.update(json.loads(self.unzip.decompress(file.read(n))))

    def load(self, k: int) -> bytes:
        at, sizes, crc = self.blocks[k]
        n = min(self.block, self.ids - k * self.block)
        self.file.seek(at)
        data = self.file.read(sum(sizes))
        found, at = [], 0
        for size in sizes:
            found.append(self.unzip.decompress(data[at : at + size], max_output_size=n) if size else b"")
            at += size
        out = unplanes(found, n, self.mode).tobytes()
        if zlib.crc32(out) != crc:
            raise ValueError(f"block {k} is damaged")
        return out

    def slice(self, start: int, stop: int) -> bytes:
        """Ids start to stop, by the blocks that hold them."""
        if stop <= start:
            return b""
        first, last = start // self.block, (stop - 1) // self.block
        data = b"".join(self.load(k) for k in range(first, last + 1))
        return data[4 * (start - first * self.block) : 4 * (stop - first * self.block)]

    def listed(self, k: int) -> list[tuple]:
        """(doc_id, token count) of the k-th block of documents."""
        at, size, n, _, none = self.lists[k]
        self.file.seek(at)
        docs, counts = np.frombuffer(self.unzip.decompress(self.file.read(size)), "<i8").reshape(2, n).tolist()
        for i in none:
            docs[i] = None
        return list(zip(docs, counts))

    def document(self, number: int) -> tuple:
        """(doc_id, ids as bytes) of the document of this number: one block of documents and the blocks of its ids are read."""
        k, own = divmod(number, DOCS)
        found = self.listed(k)
        start = self.lists[k][3] + sum(n for _, n in found[:own])
        return found[own][0], self.slice(start, start + found[own][1])

    def documents(self):
        """(doc_id, start in the file, ids as bytes) of each document."""
        held, next_block, at, start = b"", 0, 0, 0
        for k in range(len(self.lists)):
            for doc_id, n in self.listed(k):
                got = []
                need = 4 * n
                while need:
                    if at == len(held):
                        held, at, next_block = self.load(next_block), 0, next_block + 1
                    own = held[at : at + need]
                    at, need = at + len(own), need - len(own)
                    got.append(own)
                yield doc_id, start, b"".join(got)
                start += n


def _filesystem(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def write_ids(docs: DataFrame, folder: str, vocab: str, end_id: int = 0, block: int = 1 << 16, mode: str = "byte", file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes texts and writes files of about `file_ids` ids, in ascending doc_id over the files' names (null first, ties by text).
    Returns a row (path, n_ids, n_docs) for each file. A task writes each file under a name of its own and renames it at its end,
    so a task that runs twice leaves each file once."""
    spark, path = docs.sparkSession, vocabulary(vocab)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import pyspark

        encoder, part, writer, made = kept_in_worker(ByteEncoder, path), pyspark.TaskContext.get().partitionId(), None, 0
        disk, to = _filesystem(folder)

        def ended():
            name = f"{part:06d}-{made:06d}.planes"
            n = writer.close()
            disk.move(temp, f"{to}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((name, pa.string()), (n, pa.int64()), (writer.n_docs, pa.int64()))], names=["path", "n_ids", "n_docs"])

        for batch in batches:
            for own in slices(batch):
                for doc, ids in zip(own.column(0).to_pylist(), encoder.encode(own.column(1))):
                    if writer is None:
                        disk.create_dir(to, recursive=True)
                        temp = f"{to}/.{part:06d}-{uuid.uuid4().hex}"
                        writer = Writer(disk.open_output_stream(temp), block, mode)
                    writer.add(doc, ids + end)
                    if writer.n_ids >= file_ids:
                        yield ended()
                        writer, made = None, made + 1
        if writer is not None:
            yield ended()

    # rows of one doc_id are dealt by how their texts begin, so that any number of them can be spread, and stay in order
    order = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 16)]
    dealt = documents(docs).repartitionByRange(parts(spark), *order).sortWithinPartitions(order[0], "text")
    return dealt.mapInArrow(run, "path string, n_ids long, n_docs long")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_ids(spark: SparkSession, folder: str, files: list[tuple[str, int]], with_ids: bool = False) -> DataFrame:
    """Documents of the files (name, ids before it): doc_id, start, n_tokens, ids_crc32 (and ids), a task for each file."""
    if not files:
        return spark.createDataFrame([], READ + (", ids binary" if with_ids else ""))
    schema = READ + (", ids binary" if with_ids else "")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: len(names)]

    def run(batches):
        disk, at = _filesystem(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                info = disk.get_file_info(f"{at}/{name}")
                with disk.open_input_file(info.path) as file:
                    rows, held = [], 0
                    for doc, start, ids in Reader(file, info.size).documents():
                        rows.append((doc, base + start, len(ids) // 4, zlib.crc32(ids), ids)[: len(names)])
                        held += len(ids) if with_ids else 64
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    table = spark.createDataFrame(spark.sparkContext.parallelize(files, len(files)), "name string, base long")
    return table.mapInArrow(run, schema)


def token_files(docs: DataFrame, vocab: str = "byte_bpe_50k.json", end_id: int = 0, block: int = 1 << 16, mode: str = "byte", folder: str | None = None, with_ids: bool = False, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes every text, writes the files and gives the documents as read back from them.

    Null text: empty, one id (end_id). Null doc_id: first. Repeated rows: each. Empty table: no files, no rows. The driver
    holds one row for each file."""
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "planes")
    made = sorted((r.path, r.n_ids) for r in write_ids(docs, folder, vocab, end_id, block, mode, file_ids).collect())
    files, base = [], 0
    for name, n in made:
        files.append((name, base))
        base += n
    return read_ids(spark, folder, files, with_ids)
