"""Sets of small files (label files, XML documents) that appear whole or not at all: a data source for writing with a commit.

    spark.dataSource.register(FileSet)
    rows.write.format("file_set").mode("overwrite").option("path", folder).option("ending", ".txt").save()

rows: name, body. Tasks write below a hidden folder beside the target; nothing of the target changes before all tasks are done, so a
task that fails, or a job that is aborted, leaves the old set as it was. Then the new set takes its place: in mode overwrite the
folders are exchanged by two renames; in mode append the files move in by a journal that lists where they come from. A driver that
dies in between leaves the journal, and recover() (or the next write to the folder) brings what it had begun to its end.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def filesystem(uri: str):
    """(Arrow's file system, path) of a folder or file."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri.rstrip("/")
    disk, path = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
    return disk, path.rstrip("/")


def _there(disk, path: str) -> bool:
    return disk.get_file_info(path).type.name != "NotFound"


def _children(disk, path: str) -> list:
    from pyarrow import fs

    return disk.get_file_info(fs.FileSelector(path)) if _there(disk, path) else []


def _beside(path: str, kind: str, tag: str) -> str:
    parent, _, name = path.rpartition("/")
    return f"{parent}/.{name}.{kind}-{tag}"


def write_whole(disk, path: str, data: bytes) -> None:
    """A file by a temporary name and a rename: readers see the old or the new one."""
    with disk.open_output_stream(temp := _beside(path, "new", uuid.uuid4().hex)) as out:
        out.write(data)
    disk.move(temp, path)


def _move_in(disk, path: str, journal: str) -> None:
    """Moves what a journal's staging folder still holds; may be broken off and begun again."""
    with disk.open_input_stream(journal) as file:
        staged = json.loads(file.read())["staged"]
    disk.create_dir(path, recursive=True)
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(lambda x: disk.move(x.path, f"{path}/{x.base_name}"), _children(disk, staged)))
    if _there(disk, staged):
        disk.delete_dir(staged)
    disk.delete_file(journal)


def recover(folder: str) -> int:
    """Ends commits of a folder that were begun and broken off; how many there were."""
    disk, path = filesystem(folder)
    parent, _, name = path.rpartition("/")
    found = 0
    for x in _children(disk, parent):
        if x.base_name.startswith(f".{name}.journal-"):
            _move_in(disk, path, x.path)
            found += 1
        elif x.base_name.startswith(f".{name}.old-"):
            tag = x.base_name.rpartition("-")[2]
            if not _there(disk, path):  # between the two renames
                disk.move(_beside(path, "staged", tag), path)
            disk.delete_dir(x.path)
            found += 1
    return found


@dataclass
class Written(WriterCommitMessage):
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, ending: str, overwrite: bool):
        self.folder, self.ending, self.overwrite, self.tag = folder, ending, overwrite, uuid.uuid4().hex
        disk, _, staged = self._staged()
        disk.create_dir(staged, recursive=True)  # here alone: once it is gone no task that still runs can write

    def _staged(self):
        disk, path = filesystem(self.folder)
        return disk, path, _beside(path, "staged", self.tag)

    def write(self, iterator) -> Written:
        disk, _, staged = self._staged()
        n = 0
        for name, body in iterator:
            if "/" in name or not name:
                raise ValueError(f"{name!r} can't be a file's name")
            write_whole(disk, f"{staged}/{name}{self.ending}", body if isinstance(body, bytes) else (body or "").encode())
            n += 1
        return Written(n)

    def commit(self, messages) -> None:
        disk, path, staged = self._staged()
        recover(self.folder)
        for x in _children(disk, staged):  # of attempts that died while they wrote a file
            if x.base_name.startswith("."):
                disk.delete_file(x.path)
        if self.overwrite and _there(disk, path):
            disk.move(path, old := _beside(path, "old", self.tag))
            disk.move(staged, path)
            disk.delete_dir(old)
        elif not _there(disk, path):
            disk.move(staged, path)
        else:
            write_whole(disk, journal := _beside(path, "journal", self.tag), json.dumps({"staged": staged}).encode())
            _move_in(disk, path, journal)

    def abort(self, messages) -> None:
        disk, _, staged = self._staged()
        for k in range(20):  # tasks that are being stopped may still put a file there
            try:
                if _there(disk, staged):
                    disk.delete_dir(staged)
                return
            except OSError:
                time.sleep(0.1 * k)


class FileSet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_set"

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("ending", ""), overwrite)


def registered(spark: SparkSession) -> None:
    spark.dataSource.register(FileSet)
