"""Per-call objection reports and corpus statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tertulia import schemas
from tertulia.config import ReportOptions, RuleSet
from tertulia.functions.text import fold_vowels
from tertulia.operators.parsing import add_context, full_turns
from tertulia.operators.rules import hits
from tertulia.operators.turns import with_context

MAX_RULES = 1 << 20


def _type_maps(counts: list[tuple[str, Column, Column]]) -> list[Column]:
    """``objection_types`` and ``type_order`` from (type, count, first place) columns."""
    entries = F.filter(
        F.array(
            *[
                F.struct(first.alias("first"), F.lit(name).alias("type"), n.cast("int").alias("n"))
                for name, n, first in counts
            ]
        ),
        lambda e: e["n"] > 0,
    )
    in_order = F.array_sort(entries)
    pairs = F.transform(in_order, lambda e: F.struct(e["type"], e["n"]))
    return [
        F.map_from_entries(pairs).alias("objection_types"),
        F.transform(in_order, lambda e: e["type"]).alias("type_order"),
    ]


def _place(turn_no: Column, rule_no: Column) -> Column:
    """Order of an objection in its call as one number, whose minimum a hash aggregation can keep.

    A rule number beyond the width is an error, never a wrong order.
    """
    rule_no = F.when(rule_no < MAX_RULES, rule_no).otherwise(F.raise_error(F.lit("too many rules")).cast("int"))
    return turn_no.cast("bigint") * F.lit(MAX_RULES) + rule_no


def _of_type(found: str, name: str) -> Column:
    return F.filter(found, lambda hit: hit["type"] == name)


def call_report(matched: DataFrame, types: Sequence[str], client_speaker: int | Column = 1) -> DataFrame:
    """One row per call from all its turns, the client's with ``hits`` and the others' null.

    Counts per type are conditional sums, so the whole report is one partial aggregation and one exchange of
    per-call rows; nothing is collected per call. ``type_order`` has the types by first appearance.
    """
    found = F.coalesce(F.size("hits"), F.lit(0))
    level = F.aggregate("hits", F.lit(0), lambda total, h: total + h["intensity"])
    sums = [
        F.count(F.lit(1)).alias("total_turns"),
        F.count_if(F.col("speaker_num") == client_speaker).alias("client_turns"),
        F.sum(found).alias("objections_found"),
        F.sum(F.coalesce(level, F.lit(0))).alias("_level"),
    ]
    for i, name in enumerate(types):
        matched = matched.withColumn(f"_of_{i}", _of_type("hits", name))
        of_type = F.col(f"_of_{i}")
        place = _place(F.col("turn_no"), F.get(of_type, 0)["rule_no"])
        sums += [
            F.sum(F.coalesce(F.size(of_type), F.lit(0))).alias(f"_n_{i}"),
            F.min(F.when(F.size(of_type) > 0, place)).alias(f"_first_{i}"),
        ]
    totals = matched.groupBy("archivo").agg(*sums)
    mean = F.when(F.col("objections_found") > 0, F.col("_level") / F.col("objections_found"))
    return totals.select(
        F.col("archivo").alias("file"),
        "total_turns",
        "client_turns",
        "objections_found",
        *_type_maps([(name, F.col(f"_n_{i}"), F.col(f"_first_{i}")) for i, name in enumerate(types)]),
        F.coalesce(mean, F.lit(0.0)).alias("avg_intensity"),
    )


def _detail(hit: Column, turn: Column) -> Column:
    """The nine columns of an objection."""
    return F.struct(
        hit["type"].alias("type"),
        hit["intensity"].alias("intensity"),
        hit["matched_text"].alias("matched_text"),
        hit["pattern"].alias("pattern"),
        turn["timestamp"].alias("timestamp"),
        turn["speaker"].alias("speaker"),
        turn["text"].alias("full_text"),
        turn["context_before"].alias("context_before"),
        turn["context_after"].alias("context_after"),
    )


def _plain_turn(turn: Column) -> Column:
    return F.struct(*[turn[name].alias(name) for name in ("speaker", "speaker_num", "timestamp", "text")])


def call_documents(
    calls: DataFrame, rules: RuleSet, options: ReportOptions = ReportOptions(), client: str | None = None
) -> DataFrame:
    """One nested report per call of ``archivo, raw``, computed inside the row, without any exchange.

    ``client`` names a column with the client's speaker number of each call, where it is known.
    """
    speaker = F.lit(options.client_speaker)
    if client is not None:
        speaker = F.coalesce(F.col(client), speaker)
    turns = calls.select("archivo", speaker.alias("_client"), full_turns(F.col("raw")).alias("_turns"))
    turns = turns.withColumn("_turns", add_context(F.col("_turns"), options.context_size))

    def fold(turn: Column) -> Column:
        return turn.withField("folded", fold_vowels(turn["text"]))

    def numbered_detail(hit: Column, turn: Column) -> Column:
        detail = _detail(hit, turn)
        return detail.withField("_rule", hit["rule_no"]).withField("_turn", turn["turn_no"])

    said = F.filter("_turns", lambda turn: turn["speaker_num"] == F.col("_client"))
    found = F.flatten(
        F.transform(
            "_said",
            lambda turn: F.transform(turn["hits"], lambda hit: numbered_detail(hit, turn["turn"])),
        )
    )
    searched = F.transform(
        "_said", lambda turn: F.struct(turn.alias("turn"), hits(turn["folded"], rules).alias("hits"))
    )
    work = (
        turns.withColumn("_said", F.transform(said, fold))
        .withColumn("_said", searched)
        .withColumn("_found", found)
        .withColumn("_n", F.size("_found"))
    )

    def counted(name: str) -> tuple[str, Column, Column]:
        of_type = _of_type("_found", name)
        first = F.get(of_type, 0)
        return name, F.size(of_type), _place(first["_turn"], first["_rule"])

    total = F.aggregate("_found", F.lit(0), lambda s, o: s + o["intensity"])
    columns = [
        F.col("archivo").alias("file"),
        F.size("_turns").alias("total_turns"),
        F.size("_said").alias("client_turns"),
        F.col("_n").alias("objections_found"),
        *_type_maps([counted(name) for name in rules.types]),
    ]
    if options.include_intensity:
        columns.append(
            F.when(F.col("_n") > 0, total / F.col("_n")).otherwise(F.lit(0.0)).alias("avg_intensity")
        )
    if options.include_details:
        columns.append(F.transform("_found", lambda o: o.dropFields("_rule", "_turn")).alias("objections"))
    if options.include_turns:
        columns.append(F.transform("_turns", _plain_turn).alias("turns"))
    return work.select(*columns)


def document_parts(
    matched: DataFrame, context_size: int = 100, turns_per_part: int | None = None
) -> DataFrame:
    """Nested ``objections`` and ``turns`` of a turn table with hits, by ``file, part``, in one exchange.

    A call is one document, part 0. With ``turns_per_part`` a caller may cut it into parts of so many turn numbers,
    where a call would not fit into one row. Context comes from the neighbouring turns, across parts too.
    """
    if turns_per_part is None:
        seen = matched.withColumn("_part", F.lit(0))
        turns = F.array_sort(F.collect_list(_hit_turn()))
        parts = seen.groupBy(F.col("archivo").alias("file"), F.col("_part").alias("part")).agg(turns.alias("_turns"))
        own = parts.withColumn("_turns", add_context(F.col("_turns"), context_size))
    else:
        near = with_context(matched, context_size)
        part = F.floor(F.col("turn_no") / turns_per_part).cast("int").alias("part")
        turn = F.struct(*_HIT_TURN, _hits().alias("hits"), "context_before", "context_after")
        own = near.groupBy(F.col("archivo").alias("file"), part).agg(
            F.array_sort(F.collect_list(turn)).alias("_turns")
        )
    found = F.flatten(
        F.transform("_turns", lambda t: F.transform(t["hits"], lambda h: _detail(h, t)))
    )
    return own.select(
        "file", "part", found.alias("objections"), F.transform("_turns", _plain_turn).alias("turns")
    )


_HIT_TURN = ("turn_no", "speaker", "speaker_num", "timestamp", "text")


def _hits() -> Column:
    return F.coalesce(F.col("hits"), F.array().cast(f"array<{schemas.HIT}>"))


def _hit_turn() -> Column:
    return F.struct(*_HIT_TURN, _hits().alias("hits"))


def objection_counts(objections: DataFrame) -> DataFrame:
    """Objections and mean intensity per call, from an objections table."""
    return objections.groupBy("archivo").agg(
        F.count(F.lit(1)).alias("objections_found"), F.avg("intensity").alias("avg_intensity")
    )


def call_counts(turns: DataFrame, objections: DataFrame, client_speaker: int = 1) -> DataFrame:
    """``archivo, total_turns, client_turns, objections_found, avg_intensity``; calls without objections stay."""
    spoken = turns.groupBy("archivo").agg(
        F.count(F.lit(1)).alias("total_turns"),
        F.count_if(F.col("speaker_num") == client_speaker).alias("client_turns"),
    )
    return spoken.join(objection_counts(objections), "archivo", "left").withColumns(
        {
            "objections_found": F.coalesce(F.col("objections_found"), F.lit(0)),
            "avg_intensity": F.coalesce(F.col("avg_intensity"), F.lit(0.0)),
        }
    )


def type_counts(objections: DataFrame) -> DataFrame:
    """``archivo, objection_types``: a map from type to count, for the calls that have objections."""
    by_type = objections.groupBy("archivo", "type").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return by_type.groupBy("archivo").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("objection_types")
    )


def first_names(types: Sequence[str]) -> list[str]:
    """Columns of ``corpus_sums`` that hold where a type was first seen."""
    return [f"first_{i}" for i in range(len(types))]


def corpus_sums(reports: DataFrame, types: Sequence[str]) -> DataFrame:
    """One row over reports that can be added up with others: counts, the sum of the calls' mean intensities, and for
    each type the number of its calls and the first place it was seen at, calls taken by name.

    The intensities are decimals, so that their sum does not depend on the order.
    """
    intensity = F.col("avg_intensity") if "avg_intensity" in reports.columns else F.lit(0)
    sums = [
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.sum("objections_found"), F.lit(0)).alias("total_objections"),
        F.sum(intensity.cast("decimal(28,18)")).cast("decimal(38,18)").alias("intensity"),
    ]
    for i, name in enumerate(types):
        place = F.array_position("type_order", name)
        sums.append(F.count_if(place > 0).alias(f"calls_{i}"))
    for first, name in zip(first_names(types), types, strict=True):
        place = F.array_position("type_order", name)
        sums.append(F.min(F.when(place > 0, F.struct("file", place.alias("place")))).alias(first))
    return reports.agg(*sums)


def corpus_row(sums: DataFrame, types: Sequence[str]) -> DataFrame:
    """The corpus statistics of the sums of all reports.

    The most common objection is the type found in the most calls; a tie goes to the one seen first, calls taken by
    name. The overall intensity is the plain mean of the calls' means.
    """
    kinds = [
        F.struct((-F.col(f"calls_{i}")).alias("n"), F.col(first).alias("first"), F.lit(name).alias("type"))
        for i, (first, name) in enumerate(zip(first_names(types), types, strict=True))
    ]
    ranking = F.array_sort(F.filter(F.array(*kinds), lambda e: e["n"] < 0))

    def mean(total: Column) -> Column:
        return F.when(F.col("total_files") > 0, total / F.col("total_files"))

    return sums.select(
        "total_files",
        "total_objections",
        F.coalesce(mean(F.col("total_objections")), F.lit(0.0)).alias("avg_objections_per_file"),
        F.get(ranking, 0)["type"].alias("most_common_objection"),
        F.coalesce(mean(F.col("intensity").cast("double")), F.lit(0.0)).alias("overall_avg_intensity"),
    )


def corpus_stats(reports: DataFrame, types: Sequence[str]) -> DataFrame:
    """One row over all reports, see ``corpus_row``."""
    return corpus_row(corpus_sums(reports, types), types)
