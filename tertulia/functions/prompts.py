"""Prompt texts built as column expressions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill_template(template: str, **values: Column) -> Column:
    """Template text with ``{name}`` places filled per row. Braces in the data are plain text."""
    pieces: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is not None:
            if name not in values:
                raise ValueError(f"template place {name!r} has no column")
            pieces.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")


def objection_prompt(template: str, columns: list[str]) -> Column:
    """Review prompt of a detection row; a column the row lacks counts as empty."""

    def value(name: str) -> Column:
        return F.col(name) if name in columns else F.lit("")

    return fill_template(
        template,
        category=value("categoria"),
        obj_type=value("tipo"),
        phrase=value("frase_original"),
    )


def summary_prompt(text: Column, instruction: str) -> Column:
    """The caller's instruction, a blank line, and the transcript."""
    return F.concat(F.lit(instruction + "\n\n"), text)
