"""File listing as a Python data source: tasks walk the folders, the driver only names those of the first levels.

``spark.read.format("folder_listing").load(root)`` gives ``path, length, modified``. Names that begin with a dot or an
underscore are left out, as in Spark's own listings. Paths are plain: blanks and other signs are not escaped.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length bigint, modified timestamp"
_ARROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])
BATCH_ROWS = 10_000
#: Bytes of a file that a task reads at a time for its hash.
BLOCK_BYTES = 1 << 20
#: Folders are opened level by level until there are as many as this, or no deeper ones.
FOLDERS_WANTED = 256
#: Tasks of a listing at most; folders are dealt over them in turn.
TASKS = 1024


def is_mounted(root: str) -> bool:
    """Whether a path is one of the file system: no scheme, or ``file:``."""
    return re.match(r"(?!file:)[A-Za-z][A-Za-z0-9+.-]*:", root) is None


def local_folder(root: str) -> str:
    """Folder of a path; escapes count only in the form with a scheme. Other stores than the file system are refused."""
    if not is_mounted(root):
        raise ValueError(f"not a folder of the file system: {root}")
    plain = unquote(re.sub("^file:(?://[^/]*)?", "", root)) if root.startswith("file:") else root
    return plain.rstrip("/") or "/"


def _entries(folder: str) -> Iterator[os.DirEntry]:
    with os.scandir(folder) as found:
        for entry in found:
            if not entry.name.startswith((".", "_")):
                yield entry


class Folders(InputPartition):
    """``flat``: folders of which only the files directly inside are wanted; ``deep``: whole trees."""

    def __init__(self, flat: list[str], deep: list[str]):
        self.flat, self.deep = flat, deep


class FolderReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = local_folder(root)

    def partitions(self) -> list[Folders]:
        """Trees below the root, dealt over tasks. Only names of folders are kept, so files do not count in the driver."""
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"no folder {self.root}")
        opened, level = [], [self.root]
        while level and len(level) < FOLDERS_WANTED:
            opened += level
            level = [entry.path for folder in level for entry in _entries(folder) if entry.is_dir()]
        flat, deep = sorted(opened), sorted(level)
        n = min(TASKS, max(len(flat), len(deep)))
        return [Folders(flat[i::n], deep[i::n]) for i in range(n)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, datetime]] = []
        for row in self._files(partition):
            rows.append(row)
            if len(rows) == BATCH_ROWS:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _files(self, partition: Folders) -> Iterator[tuple[str, int, datetime]]:
        open_folders = [(folder, False) for folder in partition.flat] + [(folder, True) for folder in partition.deep]
        while open_folders:
            folder, whole = open_folders.pop()
            for entry in _entries(folder):
                if entry.is_dir():
                    if whole:
                        open_folders.append((entry.path, True))
                elif entry.is_file():
                    facts = entry.stat()
                    yield entry.path, facts.st_size, datetime.fromtimestamp(facts.st_mtime, timezone.utc)


def _batch(rows: list[tuple[str, int, datetime]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows), _ARROW)], schema=_ARROW)


class FolderListing(DataSource):
    """Data source ``folder_listing``."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"])


def register(spark: SparkSession) -> str:
    """Make the source known to a session; returns its name."""
    spark.dataSource.register(FolderListing)
    return FolderListing.name()


def file_digest(path: str) -> str:
    """SHA-256 of a file, read block by block."""
    state = hashlib.sha256()
    with open(path, "rb") as data:
        while block := data.read(BLOCK_BYTES):
            state.update(block)
    return state.hexdigest()


def file_digests(files: DataFrame) -> DataFrame:
    """``path, sha256`` of listed files. Tasks stream them, so a file may be larger than a row can hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [file_digest(path) for path in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], ["path", "sha256"])

    return files.select("path").mapInArrow(run, "path string, sha256 string")
