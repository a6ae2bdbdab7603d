"""Transcript text to turns, and transcript cleaning.

A call is one row and stays one row until its turns are exploded: each parser is an array expression on
the raw text, so none of these jobs shuffles, and what needs the neighbouring turn (context, duration) is
taken from the array at that point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tertulia.config import CleanOptions
from tertulia.functions import text as T

# The header formats of a transcript.
FULL_HEADER = rf"Speaker{T.BLANK}+\d+:{T.BLANK}*\{{{T.BLANK}*\d+:\d+{T.BLANK}*\}}"
FULL_HEADER_PARTS = (
    rf"(?sU)\A(Speaker{T.BLANK}+(\d+)):{T.BLANK}*\{{{T.BLANK}*(\d+:\d+){T.BLANK}*\}}(.*)\z"
)
FULL_TURN = rf"(?sU){FULL_HEADER}.*?(?={FULL_HEADER}|\z)"

METRIC_TURN = (
    rf"(?dU)(Speaker{T.BLANK}\d+):{T.BLANK}*\{{{T.BLANK}*(\d+:\d+){T.BLANK}*\}}{T.BLANK}*(.*)"
)

LINE_BLANK = r"[\s\x1c-\x1f&&[^\n]]"
SPEAKER_SEGMENT = r"(?msd)(?:^Speaker|\A).*?(?=^Speaker|\z)"
CLEAN_TURN = rf"(?sdU)(?:\A|\n){LINE_BLANK}*Speaker{LINE_BLANK}+(\d+):[^\n]*(?:\n(.*))?\z"

LINE_HEADER = rf"(?dU)\A(Speaker{T.BLANK}+\d+:.*?\}}){T.BLANK}*(.*)\z"
NOT_SPOKEN = "---"


def _explode(calls: DataFrame, rest: list[str]) -> DataFrame:
    """One row per element of ``turns``.

    The outer form and the filter after it keep the optimiser from adding a filter on the array's size, which
    it would push below the parse and so parse every text twice.
    """
    return calls.select(*rest, F.inline_outer("turns")).where(F.col("turn_no").isNotNull())


def _spans(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def full_turns(raw: Column) -> Column:
    """Array of turns, each with everything said up to the next header, trimmed at the ends only."""

    def turn(span: Column, position: Column) -> Column:
        def part(group: int) -> Column:
            return F.regexp_extract(span, FULL_HEADER_PARTS, group)

        return F.struct(
            position.alias("turn_no"),
            part(1).alias("speaker"),
            part(2).try_cast("int").alias("speaker_num"),
            part(3).alias("timestamp"),
            T.to_seconds(part(3)).alias("start_sec"),
            T.strip(part(4)).alias("text"),
        )

    return F.transform(_spans(raw, FULL_TURN), turn)


def add_context(turns: Column, size: int) -> Column:
    """The turns of an array column, each with the leading characters of the turn before and after."""

    def neighbour(position: Column) -> Column:
        return F.coalesce(F.left(F.get(turns, position)["text"], F.lit(size)), F.lit(""))

    def widen(turn: Column, position: Column) -> Column:
        return turn.withField("context_before", neighbour(position - 1)).withField(
            "context_after", neighbour(position + 1)
        )

    return F.transform(turns, widen)


def parse_turns(calls: DataFrame, context_size: int | None = None) -> DataFrame:
    """One row per turn of the ``raw`` column; the other columns of the call are carried along.

    With ``context_size``, each turn also has that many characters of its neighbours.
    """
    rest = [name for name in calls.columns if name != "raw"]
    turns = calls.select(*rest, full_turns(F.col("raw")).alias("turns"))
    if context_size is not None:
        turns = turns.withColumn("turns", add_context(F.col("turns"), context_size))
    return _explode(turns, rest)


def metric_turns(raw: Column) -> Column:
    """Array of ``turn_no, speaker, start_sec, speech``; only the first line of speech is kept.

    Header and blanks may span lines, so an empty turn takes the next header as its speech.
    """

    def turn(span: Column, position: Column) -> Column:
        return F.struct(
            position.alias("turn_no"),
            F.regexp_extract(span, METRIC_TURN, 1).alias("speaker"),
            T.to_seconds(F.regexp_extract(span, METRIC_TURN, 2)).alias("start_sec"),
            F.regexp_extract(span, METRIC_TURN, 3).alias("speech"),
        )

    return F.transform(_spans(raw, METRIC_TURN), turn)


def parse_metric_turns(calls: DataFrame) -> DataFrame:
    """Timed turns with ``duration_sec``: time to the next turn of any speaker, never negative, 0 at the end."""
    rest = [name for name in calls.columns if name != "raw"]
    turns = F.col("turns")

    def timed(turn: Column, position: Column) -> Column:
        gap = F.get(turns, position + 1)["start_sec"] - turn["start_sec"]
        return turn.withField("duration_sec", F.greatest(F.lit(0), F.coalesce(gap, F.lit(0))))

    timed_turns = (
        calls.select(*rest, metric_turns(F.col("raw")).alias("turns"))
        .withColumn("turns", F.transform(turns, timed))
    )
    return _explode(timed_turns, rest)


def spoken_turns(clean: Column) -> Column:
    """Array of ``turn_no, speaker_num, texto`` of a cleaned transcript.

    Lines that start with ``Speaker`` cut the text into segments. In each, the first line that is a header
    when stripped opens the turn, and the lines below it are its text; segments without one say nothing.
    """
    segments = _spans(F.regexp_replace(clean, T.LINE_BREAK, "\n"), SPEAKER_SEGMENT)
    headed = F.filter(segments, lambda segment: segment.rlike(CLEAN_TURN))

    def turn(segment: Column, position: Column) -> Column:
        lines = F.split(F.regexp_extract(segment, CLEAN_TURN, 2), "\n", -1)
        said = F.filter(F.transform(lines, T.strip), lambda line: line != "")
        return F.struct(
            position.alias("turn_no"),
            F.regexp_extract(segment, CLEAN_TURN, 1).try_cast("int").alias("speaker_num"),
            F.array_join(said, " ").alias("texto"),
        )

    return F.transform(headed, turn)


def parse_clean_turns(calls: DataFrame) -> DataFrame:
    """One row per turn of the ``clean`` column, all speakers, empty turns included."""
    rest = [name for name in calls.columns if name != "clean"]
    return _explode(calls.select(*rest, spoken_turns(F.col("clean")).alias("turns")), rest)


def clean_transcript(raw: Column, options: CleanOptions = CleanOptions()) -> Column:
    """Cleaned text that keeps speaker headers, blank lines and ruler lines as they are."""

    def clean(text: Column) -> Column:
        return T.clean_text(
            text, options.fillers, options.strip_accents, options.remove_punctuation
        )

    if not options.keep_speakers:
        return clean(raw)

    def clean_line(line: Column) -> Column:
        header = F.regexp_extract(line, LINE_HEADER, 1)
        content = clean(F.regexp_extract(line, LINE_HEADER, 2))
        spoken = T.strip(line)
        return (
            F.when(header != "", T.strip(F.concat(header, F.lit(" "), content)))
            .when((spoken == "") | spoken.startswith(NOT_SPOKEN), line)
            .otherwise(clean(line))
        )

    return F.array_join(F.transform(T.text_lines(raw), clean_line), "\n")


def clean_call(calls: DataFrame, options: CleanOptions = CleanOptions()) -> DataFrame:
    """The ``raw`` column replaced by its cleaned form ``clean``."""
    rest = [name for name in calls.columns if name != "raw"]
    return calls.select(*rest, clean_transcript(F.col("raw"), options).alias("clean"))
