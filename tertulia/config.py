"""Job parameters. Every word list, rule and threshold is the caller's."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from tertulia.functions.patterns import to_java


@dataclass(frozen=True)
class CleanOptions:
    fillers: tuple[str, ...] = ()
    strip_accents: bool = True
    remove_punctuation: bool = True
    keep_speakers: bool = True


@dataclass(frozen=True)
class ChunkOptions:
    """A sentence must be longer than ``min_sentence_length`` characters, a chunk have ``min_words`` words."""

    min_sentence_length: int
    min_words: int
    window: int
    overlap: int
    irrelevant: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.window:
            raise ValueError("overlap must be at least 0 and smaller than the window")


@dataclass(frozen=True)
class ReportOptions:
    client_speaker: int = 1
    context_size: int = 100
    include_turns: bool = True
    include_details: bool = True
    include_intensity: bool = True


@dataclass(frozen=True)
class Rule:
    rule_no: int
    type: str
    category: str
    type_ord: int
    category_ord: int
    pattern_ord: int
    pattern: str
    intensity: int


@dataclass(frozen=True)
class RuleSet:
    """Ordered rules: type, then category, then patterns; each category has an intensity, 1 if not given."""

    patterns: Mapping[str, Mapping[str, Sequence[str]]]
    intensity: Mapping[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for rule in self.rules():
            to_java(rule.pattern)

    def rules(self) -> list[Rule]:
        out: list[Rule] = []
        for type_ord, (name, categories) in enumerate(self.patterns.items()):
            for category_ord, (category, patterns) in enumerate(categories.items()):
                level = self.intensity.get(category, 1)
                for pattern_ord, pattern in enumerate(patterns):
                    out.append(
                        Rule(len(out), name, category, type_ord, category_ord, pattern_ord, pattern, level)
                    )
        return out

    def categories(self) -> list[list[Rule]]:
        """Rules grouped by (type, category), in rule order."""
        groups: dict[tuple[int, int], list[Rule]] = {}
        for rule in self.rules():
            groups.setdefault((rule.type_ord, rule.category_ord), []).append(rule)
        return list(groups.values())

    @property
    def types(self) -> list[str]:
        return list(self.patterns)
