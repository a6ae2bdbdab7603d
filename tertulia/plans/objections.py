"""Transcripts to rule-based objections, call reports and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tertulia.config import ReportOptions, RuleSet
from tertulia.operators.parsing import parse_turns
from tertulia.operators.reports import call_documents, corpus_stats
from tertulia.operators.rules import detect_objections


def analyse_calls(
    calls: DataFrame, rules: RuleSet, options: ReportOptions = ReportOptions(), client: str | None = None
) -> DataFrame:
    """A nested report per call. No exchange: each call is analysed within its row."""
    return call_documents(calls, rules, options, client)


def list_objections(
    calls: DataFrame, rules: RuleSet, client_speaker: int = 1, clients: DataFrame | None = None,
    context_size: int = 100,
) -> DataFrame:
    """Objections as rows; context comes from the parse, so the turns are not regrouped."""
    turns = parse_turns(calls, context_size)
    return detect_objections(turns, rules, client_speaker, clients, context_size)


def analyse_corpus(calls: DataFrame, rules: RuleSet, options: ReportOptions = ReportOptions()) -> DataFrame:
    return corpus_stats(analyse_calls(calls, rules, options), rules.types)
