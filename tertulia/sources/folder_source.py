"""A Python data source for folders of many small files, in batches and as a stream.

In batch, a partition is a set of folders, or a range of the hashes of file names in one folder. Its task lists what is
its own and reads it; the driver lists folders at most, never files. Files of zero bytes are rows, and so are files that
are too large or cannot be read, with the reason.

As a stream, the offset is the number of listings taken. Whenever new names are found, they are written, sorted by hash,
as one more Parquet file to the folder ``seen``; batches read the listings between two offsets, by ranges of hashes. So
a repeated batch reads the same files, a file is read once however late it came and whatever its times say, and the
driver holds 16 bytes for each file seen. One stream at a time may write to a folder ``seen``.

Only ``.txt`` files that are not hidden (``.`` or ``_`` first) count; subfolders are left out. A path may hold ``*`` in
place of whole folder names.
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "archivo string, value binary, parse_error string"
_SCHEMA = pa.schema([("archivo", pa.string()), ("value", pa.binary()), ("parse_error", pa.string())])
#: Paths are JSON strings, which also hold names that are no valid text.
_LISTING = pa.schema([("place", pa.uint64()), ("rest", pa.uint64()), ("path", pa.string()), ("size", pa.int64())])
_DIGEST = np.dtype([("place", "<u8"), ("rest", "<u8")])
#: Bytes and rows of a batch, and files that one task of a stream reads, at most about.
BATCH_BYTES, BATCH_ROWS, FILES_PER_TASK = 16 << 20, 2000, 2000


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and place of a path; raises ``ValueError`` or ``pyarrow.ArrowInvalid`` for stores unknown here."""
    local = re.sub("^file:/+", "/", path)
    if re.match("[A-Za-z][A-Za-z0-9+.-]+:", local):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(local)


def shown_name(name: str) -> str:
    return os.fsencode(name).decode("utf-8", "replace")


def _content(fs: pafs.FileSystem, path: str) -> bytes:
    if isinstance(fs, pafs.LocalFileSystem):
        with open(path, "rb") as file:
            return file.read()
    return fs.open_input_stream(path, compression=None).read()


def entries(fs: pafs.FileSystem, folder: str) -> Iterator[tuple[str, int, bool]]:
    """(name, bytes, whether it is a folder) of what lies in a folder, hidden names left out."""
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                if not e.name.startswith((".", "_")):
                    try:
                        yield e.name, e.stat().st_size, e.is_dir()
                    except OSError:
                        continue  # gone meanwhile
        return
    for info in fs.get_file_info(pafs.FileSelector(folder)):
        name = info.path.rstrip("/").rpartition("/")[2]
        if not name.startswith((".", "_")):
            yield name, info.size or 0, info.type == pafs.FileType.Directory


def folders(fs: pafs.FileSystem, pattern: str) -> list[str]:
    """The folders that a path names, ``*`` standing for whole names."""
    head, *rest = re.split(r"/(?=[^/]*[*?\[])", pattern, maxsplit=1)
    if not rest:
        if fs.get_file_info(pattern).type != pafs.FileType.Directory:
            raise FileNotFoundError(pattern)
        return [pattern]
    level, _, deeper = rest[0].partition("/")
    own = sorted(n for n, _, is_dir in entries(fs, head) if is_dir and fnmatch.fnmatchcase(n, level))
    return [f for n in own for f in folders(fs, f"{head}/{n}" + (f"/{deeper}" if deeper else ""))]


def texts_in(fs: pafs.FileSystem, folder: str) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the transcripts of a folder."""
    for name, size, is_dir in entries(fs, folder):
        if name.endswith(".txt") and not is_dir:
            yield f"{folder}/{name}", size


def read_files(fs: pafs.FileSystem, files: Iterator[tuple[str, int]], max_bytes: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    for path, size in files:
        name, value, error = shown_name(path.rpartition("/")[2]), None, None
        if size > max_bytes:
            error = "file too large"
        else:
            try:
                value = _content(fs, path)
            except OSError as problem:
                error = f"cannot be read: {type(problem).__name__}"
        rows.append((name, value, error))
        held += len(value or b"")
        if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def write_files(rows: DataFrame, path: str) -> None:
    """The lines ``value`` (binary; null is an empty one) of each ``part`` as one file, in a folder of the part's own.

    A part's rows meet in one task, which streams them to a hidden name and moves the file into place, so a repeated task
    replaces its own. Spark's writer takes many times as long for a small file: it makes, moves and lists each one's folder
    several times, at the end on the driver alone. It stands in for stores that Python workers cannot open. Runs a job.
    """
    place, dealt = qualified(rows.sparkSession, path), rows.select("part", "value").repartition("part")
    if not is_readable(place):
        dealt.select(F.col("value").cast("string").alias("value"), "part").write.partitionBy("part").text(path)
        return
    store(place)[0].create_dir(store(place)[1], recursive=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = store(place)
        lines = (line for batch in batches for line in zip(*batch.columns))
        files = 0
        for part, own in groupby(lines, lambda line: line[0].as_py()):
            folder = f"{top}/part={quote(part, safe='')}"
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(made := f"{folder}/.{uuid.uuid4().hex}", compression=None, buffer_size=1 << 20) as file:
                for _, value in own:
                    file.write((value.as_py() or b"") + b"\n")
            fs.move(made, f"{folder}/lines.txt")
            files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])

    dealt.sortWithinPartitions("part").mapInArrow(work, "files long").agg(F.sum("files")).collect()


def _hash(path: str) -> int:
    return xxhash.xxh3_64_intdigest(os.fsencode(path))


@dataclass
class Names(InputPartition):
    """Files of some folders whose hash leaves ``own`` when divided by ``parts``."""

    folders: list[str]
    own: int
    parts: int


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.max_bytes, self.tasks = options["path"], int(options["maxBytes"]), int(options["tasks"])

    def partitions(self) -> list[Names]:
        found = folders(*store(self.path))
        if not found:
            return [Names([], 0, 1)]
        parts = -(-self.tasks // len(found))
        if parts > 1:
            return [Names([f], k, parts) for f in found for k in range(parts)]
        return [Names(found[k :: self.tasks], 0, 1) for k in range(self.tasks)]

    def files(self, partition: Names) -> Iterator[tuple[str, int]]:
        fs, _ = store(self.path)
        own = (e for folder in partition.folders for e in texts_in(fs, folder))
        if partition.parts > 1:
            own = (e for e in own if _hash(e[0]) % partition.parts == partition.own)
        return own

    def read(self, partition: Names) -> Iterator[pa.RecordBatch]:
        yield from read_files(store(self.path)[0], self.files(partition), self.max_bytes)


@dataclass
class Listed(InputPartition):
    """Files of some listings whose hash lies in a range."""

    listings: list[str]
    least: int
    most: int


class FolderStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.seen, self.max_bytes = options["path"], options["seen"], int(options["maxBytes"])
        self.files_per_task = int(options["filesPerTask"])
        self.digests: np.ndarray | None = None
        self.listings = 0

    def initialOffset(self) -> dict:
        return {"listings": 0}

    def _listing(self, number: int) -> str:
        return f"{store(self.seen)[1]}/{number:09d}.parquet"

    def _load(self) -> None:
        fs, place = store(self.seen)
        fs.create_dir(place, recursive=True)
        names = [i.path for i in fs.get_file_info(pafs.FileSelector(place)) if i.path.endswith(".parquet")]
        self.listings = len(names)
        parts = [pq.read_table(n, filesystem=fs, columns=["place", "rest"]) for n in names]
        self.digests = np.concatenate([np.zeros(0, _DIGEST), *map(_digests_of, parts)])

    def latestOffset(self) -> dict:
        if self.digests is None:
            self._load()
        fs, pattern = store(self.path)
        paths, sizes = [], []
        for folder in folders(fs, pattern):
            for path, size in texts_in(fs, folder):
                paths.append(path)
                sizes.append(size)
                if len(paths) >= 1_000_000:
                    self._keep(paths, sizes)
                    paths, sizes = [], []
        self._keep(paths, sizes)
        return {"listings": self.listings}

    def _keep(self, paths: list[str], sizes: list[int]) -> None:
        """Writes a listing of the names that are new, if there are any."""
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(os.fsencode(p)) for p in paths), _DIGEST)
        new = np.flatnonzero(~np.isin(digests, self.digests))
        if not len(new):
            return
        new = new[np.argsort(digests["place"][new])]
        columns = [digests["place"][new], digests["rest"][new], [json.dumps(paths[k]) for k in new], [sizes[k] for k in new]]
        table = pa.table([pa.array(c, f.type) for c, f in zip(columns, _LISTING)], schema=_LISTING)
        fs, place = store(self.seen)
        target = self._listing(self.listings)
        pq.write_table(table, f"{place}/.listing", filesystem=fs, row_group_size=50_000)
        fs.move(f"{place}/.listing", target)
        self.digests = np.concatenate([self.digests, digests[new]])
        self.listings += 1

    def partitions(self, start: dict, end: dict) -> list[Listed]:
        fs, _ = store(self.seen)
        names = [self._listing(k) for k in range(start["listings"], end["listings"])]
        files = sum(pq.read_metadata(n, filesystem=fs).num_rows for n in names)
        count = max(1, -(-files // self.files_per_task))
        edges = [(k << 64) // count for k in range(count + 1)]
        return [Listed(names, a, b - 1) for a, b in zip(edges, edges[1:])]

    def read(self, partition: Listed) -> Iterator[pa.RecordBatch]:
        own, _ = store(self.seen)
        least, most = (pa.scalar(x, pa.uint64()) for x in (partition.least, partition.most))
        limits = [("place", ">=", least), ("place", "<=", most)]

        def files() -> Iterator[tuple[str, int]]:
            for name in partition.listings:
                table = pq.read_table(name, filesystem=own, columns=["path", "size"], filters=limits)
                yield from zip(map(json.loads, table["path"].to_pylist()), table["size"].to_pylist())

        yield from read_files(store(self.path)[0], files(), self.max_bytes)

    def commit(self, end: dict) -> None:
        pass


def _digests_of(table: pa.Table) -> np.ndarray:
    out = np.empty(table.num_rows, _DIGEST)
    for name in _DIGEST.names:
        out[name] = table[name].to_numpy()
    return out


class TranscriptFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcript_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderStream(self.options)


def is_readable(path: str) -> bool:
    """Whether the path lies in a store that Python workers open."""
    try:
        store(path)
    except (ValueError, OSError, pa.ArrowException):
        return False
    return True


def qualified(spark: SparkSession, path: str) -> str:
    """A path without a scheme lies in the session's default store."""
    if re.match("[A-Za-z][A-Za-z0-9+.-]+:", path):
        return path
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return path if default.startswith("file:") else default.rstrip("/") + path
