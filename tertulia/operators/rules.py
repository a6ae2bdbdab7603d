"""Objections by ordered regex rules.

The rule set is a driver-side value. Its patterns become literal expressions next to the scan, with no join, and the
first matching pattern of each (type, category) counts, in rule order. A large set is cut into several columns of
expressions; how many rules there are never changes what one of them finds. In a large set most patterns hold a text
that every match must contain: one pass over the pieces of a turn finds which of those texts can be there, and the
other rules are not tried.
"""

from __future__ import annotations

from collections import Counter
from itertools import batched, groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tertulia import schemas
from tertulia.config import Rule, RuleSet
from tertulia.functions.patterns import required_texts, to_java
from tertulia.functions.text import fold_vowels
from tertulia.operators.turns import client_turns, with_client, with_context

#: Categories searched by one column of expressions.
CATEGORIES_PER_COLUMN = 50
#: Rules from which on a text's pieces of ``GRAM`` characters decide which runs of ``RULES_PER_GATE`` rules are tried. A
#: rule that is passed over cannot match, so this changes the time only.
GATED_RULES, GRAM, RULES_PER_GATE = 64, 4, 16


def rules_table(spark: SparkSession, rules: RuleSet) -> DataFrame:
    rows = [
        (r.type, r.category, r.type_ord, r.category_ord, r.pattern_ord, r.pattern) for r in rules.rules()
    ]
    return spark.createDataFrame(rows, schemas.RULES)


def check_rules(spark: SparkSession, rules: RuleSet) -> None:
    """Raise when the engine does not accept a pattern. Runs a job of one row."""
    tests = [F.lit("").rlike(to_java(rule.pattern)) for rule in rules.rules()]
    if tests:
        spark.range(1).select(F.array(*tests)).collect()


def rule_grams(rules: RuleSet) -> dict[int, frozenset[str]]:
    """For the rules that have them, pieces of ``GRAM`` characters of which every text that matches holds one: of each
    required text the piece that is rarest among all of them."""
    texts = {r.rule_no: required_texts(r.pattern) for r in rules.rules()}
    long = {no: own for no, own in texts.items() if own and min(map(len, own)) >= GRAM}

    def pieces(text: str) -> list[str]:
        return [text[i : i + GRAM] for i in range(len(text) - GRAM + 1)]

    common = Counter(piece for own in long.values() for text in own for piece in set(pieces(text)))
    return {no: frozenset(min(pieces(t), key=lambda p: (common[p], p)) for t in own) for no, own in long.items()}


def _found_grams(folded: Column, grams: dict[int, frozenset[str]]) -> Column:
    """The pieces of a text that some rule needs; membership is a hash lookup, so one pass serves all rules."""
    wanted = sorted(frozenset().union(*grams.values()))
    count = F.char_length(folded) - GRAM + 1
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(starts, lambda i: F.substring(folded, i, F.lit(GRAM)))
    return F.array_distinct(F.filter(pieces, lambda piece: piece.isin(wanted)))


def _holds_one(present: Column, wanted: list[str]) -> Column:
    return F.exists(present, lambda piece: piece.isin(wanted))


def _option(folded: Column, rule: Rule) -> Column:
    pattern = to_java(rule.pattern)
    found = F.struct(
        F.lit(rule.rule_no).alias("rule_no"),
        F.lit(rule.type).alias("type"),
        F.lit(rule.category).alias("category"),
        F.lit(rule.intensity).alias("intensity"),
        F.regexp_extract(folded, pattern, 0).alias("matched_text"),
        F.lit(rule.pattern).alias("pattern"),
    )
    return F.when(folded.rlike(pattern), found)


def _first_hit(folded: Column, category: list[Rule], grams: dict[int, frozenset[str]], present: Column | None) -> Column:
    """The first rule of a category that matches, or null. Runs of rules whose pieces are all absent are passed over."""
    if present is None:
        return F.coalesce(*(_option(folded, rule) for rule in category))
    runs = []
    for needed, several in groupby(category, lambda rule: rule.rule_no in grams):
        for run in batched(several, RULES_PER_GATE):
            hit = F.coalesce(*(_option(folded, rule) for rule in run))
            if needed:
                wanted = sorted(frozenset().union(*(grams[rule.rule_no] for rule in run)))
                hit = F.when(_holds_one(present, wanted), hit)
            runs.append(hit)
    return F.coalesce(*runs)


def hit_parts(
    folded: Column, rules: RuleSet, size: int = CATEGORIES_PER_COLUMN, present: Column | None = None
) -> list[Column]:
    """Arrays that, one after the other, hold the rules that match an already folded text; ``present`` are its pieces
    that rules need, see ``present_grams``."""
    grams = rule_grams(rules) if present is not None else {}
    return [
        F.array_compact(F.array(*(_first_hit(folded, category, grams, present) for category in part)))
        for part in batched(rules.categories(), size)
    ]


def present_grams(folded: Column, rules: RuleSet) -> Column | None:
    """For a large rule set, the pieces of a text that decide which rules are tried at all."""
    if len(rules.rules()) < GATED_RULES:
        return None
    grams = rule_grams(rules)
    return _found_grams(folded, grams) if grams else None


def hits(folded: Column, rules: RuleSet) -> Column:
    """The same as one expression, for use inside a lambda."""
    none = F.array().cast(f"array<{schemas.HIT}>")
    present = present_grams(folded, rules)
    if present is None:
        return F.concat(none, *hit_parts(folded, rules))
    once = F.transform(F.array(present), lambda own: F.concat(none, *hit_parts(folded, rules, present=own)))
    return F.element_at(once, 1)


def match_rules(
    turns: DataFrame,
    rules: RuleSet,
    speaker: int | Column | None = None,
    categories_per_column: int = CATEGORIES_PER_COLUMN,
) -> DataFrame:
    """Every turn with its array ``hits``, empty when nothing matches.

    With ``speaker``, the turns of others are kept but not searched; their ``hits`` is null.
    """
    text = fold_vowels(F.col("text"))
    searched = F.lit(True) if speaker is None else F.col("speaker_num") == speaker
    folded = turns.withColumn("_folded", F.when(searched, text))
    present = present_grams(F.col("_folded"), rules)
    if present is not None:
        folded = folded.withColumn("_grams", present)
    parts = hit_parts(F.col("_folded"), rules, categories_per_column, None if present is None else F.col("_grams"))
    names = [f"_hits_{i}" for i in range(len(parts))]
    found = folded.withColumns(dict(zip(names, parts, strict=True)))
    value = F.concat(F.array().cast(f"array<{schemas.HIT}>"), *map(F.col, names))
    return found.withColumn("hits", F.when(F.col("_folded").isNotNull(), value)).drop("_folded", "_grams", *names)


def rule_objections(turns: DataFrame, rules: RuleSet) -> DataFrame:
    """One row per objection of the given turns, with the nine objection columns and the keys."""
    keep = [name for name in ("archivo", "turn_no") if name in turns.columns]
    columns = set(turns.columns)

    def text(name: str) -> Column:
        return F.col(name) if name in columns else F.lit("")

    return (
        match_rules(turns, rules)
        .select(
            *keep,
            F.inline_outer("hits"),
            text("timestamp").alias("timestamp"),
            text("speaker").alias("speaker"),
            F.col("text").alias("full_text"),
            text("context_before").alias("context_before"),
            text("context_after").alias("context_after"),
        )
        .where(F.col("rule_no").isNotNull())
    )


def with_intensity(objections: DataFrame, intensity: DataFrame, default: int = 1) -> DataFrame:
    """Intensity per category from a table ``intensity(category, intensity)``; the highest of several."""
    plain = objections.drop("intensity")
    intensity = intensity.groupBy("category").agg(F.max("intensity").alias("intensity"))
    return plain.join(intensity, "category", "left").withColumn(
        "intensity", F.coalesce(F.col("intensity"), F.lit(default))
    )


def detect_objections(
    turns: DataFrame,
    rules: RuleSet,
    client_speaker: int = 1,
    clients: DataFrame | None = None,
    context_size: int = 100,
) -> DataFrame:
    """Objections of the client's turns with context taken from all turns."""
    if "context_before" not in turns.columns:
        turns = with_context(turns, context_size)
    if clients is None:
        spoken = client_turns(turns, client_speaker)
    else:
        spoken = client_turns(with_client(turns, clients, client_speaker), F.col("client"))
    return rule_objections(spoken, rules)
