"""Huge JSON arrays and quoted tables, cut into records inside a file.

Whether a byte lies inside quotes, and how deep, depends on all bytes before it, so one file is usually one task. Here a
file is cut into ranges of bytes. One pass over them gives, for each state a range may begin in, the state it ends in
and the change of depth. These small summaries compose along the file, so every range then knows how it begins; in a
second pass each task cuts out the records that begin in its range and reads on to the end of the last one.

The files lie in a store that Python workers open (see ``folder_source.store``). The driver holds one short row per
range. A path is a file or a folder of files; hidden names (``.`` or ``_`` first) are left out.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tertulia.sources.folder_source import entries, qualified, store

#: Bytes of a range, and of the first step that reads on beyond it. Smaller ranges share tasks of as many bytes.
RANGE, STEP = 8 << 20, 1 << 16
#: Tasks of a pass for each core, if there are ranges for them, and at most.
CORE_TASKS, MOST_TASKS = 4, 100_000
RANGES = "path string, start long, end long"
SUMMARY = "path string, start long, end long, states array<int>, depths array<long>"
_SUMMARY = pa.schema(
    [("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("states", pa.list_(pa.int32())), ("depths", pa.list_(pa.int64()))]
)
_RECORDS = pa.schema([("value", pa.string())])
_QUOTE, _BACKSLASH, _LINE = 0x22, 0x5C, 0x0A
#: Change of depth at each byte.
_DEPTH = np.zeros(256, np.int64)
_DEPTH[list(b"[{")], _DEPTH[list(b"]}")] = 1, -1


def _read(path: str, start: int, end: int) -> bytes:
    fs, place = store(path)
    with fs.open_input_file(place) as file:
        file.seek(start)
        return file.read(end - start)


def json_strings(data: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """Places of the quotes that open or close strings, and the state at the end; a state is 1 inside a string, plus 2
    after a backslash that escapes what follows."""
    quotes = np.flatnonzero(data == _QUOTE)
    plain = np.flatnonzero(data != _BACKSLASH)

    def escaped(places: np.ndarray) -> np.ndarray:
        """Whether an odd number of backslashes lies right before each place."""
        before = np.searchsorted(plain, places) - 1
        last = np.where(before >= 0, plain[np.maximum(before, 0)] if len(plain) else -1, -1)
        return ((places - 1 - last + np.where(last < 0, state >> 1, 0)) & 1).astype(bool)

    if len(plain) == len(data):
        opened = quotes[1:] if state >> 1 and len(quotes) and quotes[0] == 0 else quotes
        escape = int(len(data) == 0 and state >> 1)
    else:
        opened = quotes[~escaped(quotes)]
        escape = int(escaped(np.array([len(data)]))[0])
    return opened, (state + len(opened)) & 1 | escape << 1


def json_brackets(data: np.ndarray, state: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of brackets outside strings, the change at each, the depth after each, and the state at the end."""
    strings, after = json_strings(data, state)
    places = np.flatnonzero(_DEPTH[data])
    places = places[(np.searchsorted(strings, places) + state) & 1 == 0]
    change = _DEPTH[data[places]]
    return places, change, depth + np.cumsum(change), after


def _json_summary(data: np.ndarray) -> tuple[list[int], list[int]]:
    found = [json_brackets(data, state, 0) for state in range(4)]
    return [after for *_, after in found], [int(change.sum()) for _, change, _, _ in found]


def _table_summary(data: np.ndarray) -> tuple[list[int], list[int]]:
    odd = int(np.count_nonzero(data == _QUOTE)) & 1
    return [odd, 1 - odd], [0, 0]


def _summaries(summary: Callable) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                states, depths = summary(np.frombuffer(_read(row["path"], row["start"], row["end"]), np.uint8))
                out.append(row | {"states": states, "depths": depths})
            yield pa.RecordBatch.from_pylist(out, _SUMMARY)

    return work


def json_records(path: str, start: int, end: int, size: int, state: int, depth: int, level: int) -> list[bytes]:
    """The values that begin in a range at a depth of ``level``."""
    data = _read(path, start, end)
    places, change, after, now = json_brackets(np.frombuffer(data, np.uint8), state, depth)
    starts = places[(change > 0) & (after == level + 1)].tolist()
    ends = places[(change < 0) & (after == level)]
    depth_now = int(after[-1]) if len(after) else depth
    between = b"," if level else b""
    at = 0 if depth <= level else (int(ends[0]) + 1 if len(ends) and (not starts or ends[0] < starts[0]) else len(data))
    ends = ends[ends > starts[0]].tolist() if starts else []
    out: list[bytes] = []
    for k, begin in enumerate(starts):
        gap = data[at:begin].strip()
        if gap != between and (k or gap not in (b"", between, b"[" if level and start == 0 else b"")):
            raise ValueError(f"invalid JSON in {path} before byte {start + begin}")
        if k < len(ends):
            at = ends[k] + 1
            out.append(data[begin:at])
        else:
            out.append(data[begin:] + _rest_of_value(path, end, size, now, depth_now, level))
            at = len(data)
    if at < len(data) and data[at:].strip() not in (b"", b",", b"]", b"[" if start == 0 else b"", b"[]" if start == 0 else b""):
        raise ValueError(f"invalid JSON in {path} after byte {start + at}")
    return out


def _rest_of_value(path: str, at: int, size: int, state: int, depth: int, level: int) -> bytes:
    parts, step = [], STEP
    while at < size:
        data = _read(path, at, min(size, at + step))
        places, change, after, state = json_brackets(np.frombuffer(data, np.uint8), state, depth)
        ends = places[(change < 0) & (after == level)]
        if len(ends):
            return b"".join([*parts, data[: int(ends[0]) + 1]])
        parts.append(data)
        depth = int(after[-1]) if len(after) else depth
        at, step = at + len(data), step * 2
    raise ValueError(f"invalid JSON in {path}: it ends inside a value")


def _line_ends(data: np.ndarray, state: int) -> np.ndarray:
    lines = np.flatnonzero(data == _LINE)
    return lines[(np.searchsorted(np.flatnonzero(data == _QUOTE), lines) + state) & 1 == 0]


def table_records(path: str, start: int, end: int, size: int, state: int, names: list[str], sep: str) -> list[bytes]:
    """The records that follow a line end in a range; the first range also has the header, which is checked."""
    data = _read(path, start, end)
    ends = _line_ends(np.frombuffer(data, np.uint8), state)
    edges = [0, *(ends + 1).tolist()] if start == 0 else (ends + 1).tolist()
    if not edges:
        return []
    rows = [data[a:b] for a, b in zip(edges, edges[1:])]
    tail, at, step = [data[edges[-1] :]], end, STEP
    odd = (state if start + edges[-1] == 0 else 0) + tail[0].count(b'"')
    while at < size:
        more = _read(path, at, min(size, at + step))
        found = _line_ends(np.frombuffer(more, np.uint8), odd & 1)
        if len(found):
            tail.append(more[: int(found[0])])
            break
        tail.append(more)
        odd += more.count(b'"')
        at, step = at + len(more), step * 2
    rows.append(b"".join(tail))
    if start == 0:
        header = rows.pop(0).decode("utf-8-sig").rstrip("\r\n")
        own = next(csv.reader([header], delimiter=sep), [])
        if [n.lower() for n in own] != [n.lower() for n in names]:
            raise ValueError(f"the header of {path} is {own}, not {names}")
    return [r for r in (row.rstrip(b"\r\n") for row in rows) if r]


def _records(cut: Callable) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [r.decode("utf-8", "replace") for r in cut(row)]
                for at in range(0, len(found), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(found[at : at + 4096], pa.string())], schema=_RECORDS)

    return work


def tasks_for(spark: SparkSession, ranges: int, bytes_: int) -> int:
    """Tasks for so many ranges of so many bytes: one for each ``RANGE`` bytes and ``CORE_TASKS`` a core, at least one range each."""
    return max(1, min(ranges, max(-(-bytes_ // RANGE), CORE_TASKS * spark.sparkContext.defaultParallelism), MOST_TASKS))


def _files(path: str) -> list[tuple[str, int]]:
    fs, place = store(path)
    info = fs.get_file_info(place)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = []
    for name, size, is_dir in entries(fs, place):
        found += _files(f"{path.rstrip('/')}/{name}") if is_dir else [(f"{path.rstrip('/')}/{name}", size)]
    return sorted(found)


def _begun(spark: SparkSession, path: str, summary: Callable, bytes_: int) -> list[dict]:
    """Every range of the files with the state and depth it begins in. Runs a job."""
    files = _files(path)
    sized = spark.createDataFrame(files, "path string, size long").where("size > 0")
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / bytes_))).alias("k")
    ranges = sized.select("path", "size", number).select(
        "path", (F.col("k") * bytes_).alias("start"), F.least("size", (F.col("k") + 1) * bytes_).alias("end")
    )
    count = sum(-(-size // bytes_) for _, size in files)
    summed = ranges.repartition(tasks_for(spark, count, sum(size for _, size in files))).mapInArrow(_summaries(summary), SUMMARY).collect()
    sizes, out, state, depth, before = dict(files), [], 0, 0, None
    for row in sorted(summed, key=lambda r: (r.path, r.start)):
        if row.path != before:
            state, depth, before = 0, 0, row.path
        out.append({"path": row.path, "start": row.start, "end": row.end, "size": sizes[row.path], "state": state, "depth": depth})
        state, depth = row.states[state], depth + row.depths[state]
        if row.end == sizes[row.path] and (state or depth):
            raise ValueError(f"{row.path} ends inside a value")
    return out


def _cut(spark: SparkSession, begun: list[dict], cut: Callable) -> DataFrame:
    names = "path string, start long, end long, size long, state int, depth long, level int"
    rows = spark.createDataFrame([tuple(r.get(n.split()[0], 0) for n in names.split(", ")) for r in begun], names)
    tasks = tasks_for(spark, len(begun), sum(r["end"] - r["start"] for r in begun))
    return rows.repartition(tasks).mapInArrow(_records(cut), "value string")


def split_json(spark: SparkSession, path: str, schema: str, range_bytes: int = RANGE) -> DataFrame:
    """Rows of JSON arrays of objects, or of files of one object after the other; many tasks read one file.

    A missing path and invalid JSON raise; a comma that is missing or doubled just where two ranges meet does not.
    Runs a job that looks at all bytes.
    """
    begun = _begun(spark, qualified(spark, path), _json_summary, range_bytes)
    levels = {r["path"]: _level(r["path"]) for r in begun if r["start"] == 0}
    values = _cut(
        spark,
        [r | {"level": levels[r["path"]]} for r in begun],
        lambda r: json_records(*(r[n] for n in ("path", "start", "end", "size", "state", "depth", "level"))),
    )
    return values.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def _level(path: str) -> int:
    """1 if the file is one array, else 0."""
    at, size = 0, store(path)[0].get_file_info(store(path)[1]).size
    while at < size:
        data = _read(path, at, min(size, at + STEP)).lstrip()
        if data:
            return int(data[:1] == b"[")
        at += STEP
    return 0


def split_table(spark: SparkSession, path: str, schema: str, sep: str = ";", range_bytes: int = RANGE) -> DataFrame:
    """Rows of delimited text with a header, as ``write_final`` writes it: quotes stand around whole values and are
    doubled inside them; values may hold line ends. Many tasks read one file. Runs a job that looks at all bytes."""
    begun = _begun(spark, qualified(spark, path), _table_summary, range_bytes)
    names = spark.createDataFrame([], schema).columns
    values = _cut(
        spark, begun, lambda r: table_records(*(r[n] for n in ("path", "start", "end", "size", "state")), names, sep)
    )
    options = {"mode": "FAILFAST", "sep": sep, "quote": '"', "escape": '"'}
    return values.select(F.from_csv("value", schema, options).alias("r")).select("r.*")
