"""Transcripts of any size as turns, many tasks to a file.

What makes a header does not depend on the text around it, so a piece between two headers parses to the same turns alone
as within its file. Files are cut into ranges of bytes. A first pass finds the first header that begins in each range; a
turn that is open at the end of a range goes on to the first header found after it, however many ranges lie between. A
second pass reads the pieces and parses them, and the turns are numbered through each file.

Not every header needs to be found for this, but what is found must be one. So the search, in bytes, knows headers of
plain digits and ASCII blanks, up to ``LONGEST`` bytes; others lie inside pieces, where the parser finds them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tertulia.operators.parsing import parse_turns
from tertulia.operators.turns import number_rows
from tertulia.sources.folder_source import FolderReader, Names, qualified, shown_name, store
from tertulia.sources.splitting import tasks_for
from tertulia.sources.staging import settle
from tertulia.sources.transcripts import MAX_FILE_BYTES, decoded, with_rejects

#: Bytes of a range, and of one step of the search for a place to cut.
RANGE, STEP = 8 << 20, 1 << 16
LONGEST = 1 << 12
_BLANK = rb"[\t-\r\x1c-\x20]"
#: Fixed value: the format of a header, see ``parsing.FULL_HEADER``.
HEADER = re.compile(rb"Speaker_+[0-9]+:_*\{_*[0-9]+:[0-9]+_*\}".replace(b"_", _BLANK))

_LISTED = pa.schema([("path", pa.string()), ("size", pa.int64())])
_CUT = pa.schema([("path", pa.string()), ("start", pa.int64()), ("cut", pa.int64()), ("size", pa.int64())])
_PIECE = pa.schema(
    [("path", pa.string()), ("cut", pa.int64()), ("archivo", pa.string()), ("value", pa.binary()), ("parse_error", pa.string())]
)


def _sql(schema: pa.Schema) -> str:
    kinds = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def list_files(spark: SparkSession, path: str, min_bytes: int, tasks: int | None = None) -> DataFrame:
    """``path, size`` of the transcripts larger than ``min_bytes``, listed by tasks; a path is a JSON string."""
    count = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    reader = FolderReader({"path": qualified(spark, path), "maxBytes": 0, "tasks": count})
    parts = [(json.dumps(p.folders), p.own, p.parts) for p in reader.partitions()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = reader.files(Names(json.loads(row["folders"]), row["own"], row["parts"]))
                rows = [{"path": json.dumps(p), "size": size} for p, size in found if size > min_bytes]
                yield pa.RecordBatch.from_pylist(rows, _LISTED)

    listed = spark.createDataFrame(parts, "folders string, own int, parts int").repartition(len(parts))
    return listed.mapInArrow(work, _sql(_LISTED))


def first_header(path: str, start: int, end: int) -> int | None:
    """Where the first header begins that begins between two places of a file; it may end beyond them."""
    fs, place = store(path)
    with fs.open_input_file(place) as file:
        for at in range(start, end, STEP):
            own = min(STEP, end - at)
            file.seek(at)
            found = HEADER.search(file.read(own + LONGEST))
            if found and found.start() < own:
                return at + found.start()
    return None


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        found = [r | {"cut": first_header(json.loads(r["path"]), r["start"], r["end"])} for r in rows]
        found = [r for r in found if r["cut"] is not None] + [r | {"start": -1, "cut": 0} for r in rows if r["start"] == 0]
        yield pa.RecordBatch.from_pylist([{n: r[n] for n in _CUT.names} for r in found], _CUT)


def _spread(df: DataFrame, start: str) -> DataFrame:
    """Short rows that name the bytes from ``start`` to ``end``, settled and dealt over as many tasks as those need."""
    df = settle(df)
    count, bytes_ = df.agg(F.count("*"), F.coalesce(F.sum(F.col("end") - F.col(start)), F.lit(0))).first()
    return df.repartition(tasks_for(df.sparkSession, count, bytes_))


def _pieces(max_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, place = store(json.loads(row["path"]))
                out = {"path": row["path"], "cut": row["cut"], "archivo": shown_name(place.rpartition("/")[2])}
                if row["end"] - row["cut"] > max_bytes:
                    out |= {"parse_error": "turn too large"}
                else:
                    with fs.open_input_file(place) as file:
                        file.seek(row["cut"])
                        out |= {"value": file.read(row["end"] - row["cut"])}
                yield pa.RecordBatch.from_pylist([out], _PIECE)

    return work


def read_pieces(
    spark: SparkSession,
    path: str,
    min_bytes: int = MAX_FILE_BYTES,
    range_bytes: int = RANGE,
    max_bytes: int = MAX_FILE_BYTES,
    tasks: int | None = None,
) -> DataFrame:
    """``path, cut, archivo, raw, parse_error``: the files of a folder that are larger than ``min_bytes``, in pieces.

    A piece begins at byte ``cut`` with a header. What lies before the first that is found is a piece of its own, for the
    headers it may hold. A piece of more than ``max_bytes`` and a piece that is no valid UTF-8 are rows with
    ``parse_error``; the others of the file stand. A piece is large only where a turn is. Runs jobs.
    """
    files = list_files(spark, path, max(min_bytes, 0), tasks)
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / range_bytes))).alias("k")
    ranges = files.select("path", "size", number).select(
        "path", (F.col("k") * range_bytes).alias("start"), F.least("size", (F.col("k") + 1) * range_bytes).alias("end"), "size"
    )
    cuts = settle(_spread(ranges, "start").mapInArrow(_cuts, _sql(_CUT)))
    # One short row for each range of a file.
    following = F.lead("cut").over(Window.partitionBy("path").orderBy("start"))
    pieces = cuts.select("path", "cut", F.coalesce(following, F.col("size")).alias("end")).where("cut < end")
    read = _spread(pieces, "cut").mapInArrow(_pieces(max_bytes), _sql(_PIECE))
    return decoded(read, "path", "cut")


def read_long_turns(
    spark: SparkSession,
    path: str,
    min_bytes: int = MAX_FILE_BYTES,
    range_bytes: int = RANGE,
    max_bytes: int = MAX_FILE_BYTES,
    tasks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The turns of the transcripts that ``read_transcripts`` finds too large, as ``parse_turns`` gives them with the
    ``path``, and the pieces that cannot be used. Turns are settled: a text is read and parsed once. Runs jobs.

    ``turn_no`` counts through a file; unusable pieces have no numbers. The sizes of ranges change nothing. Context and
    durations come from ``operators.turns``, which takes turn tables.
    """
    good, rejects = with_rejects(read_pieces(spark, path, min_bytes, range_bytes, max_bytes, tasks))
    # A turn takes more than one byte, so these places grow from turn to turn through the file.
    parsed = settle(parse_turns(good).withColumn("_place", F.col("cut") + F.col("turn_no")).drop("cut", "turn_no"))
    turns = number_rows(parsed, "_place", ["path"]).drop("_place")
    plain = F.from_json(F.concat(F.lit('{"p":'), "path", F.lit("}")), "p string")["p"]
    return (
        turns.select("archivo", "turn_no", "speaker", "speaker_num", "timestamp", "start_sec", "text", plain.alias("path")),
        rejects.select("archivo", "cut", "parse_error", plain.alias("path")),
    )
