"""Text clean-up and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(text: Column) -> Column:
    """Trimmed text, with an empty result turned into NULL."""
    return F.nullif(F.trim(text), F.lit(""))


def zip5(text: Column) -> Column:
    """The five-character postal code inside a padded or ZIP+4 value."""
    return F.left(F.trim(text), F.lit(5))


def first_identity(*candidates: Column) -> Column:
    """The first candidate that holds anything but blanks."""
    return F.coalesce(*[blank_to_null(c) for c in candidates])


def fold(text: Column, case_sensitive: bool) -> Column:
    """Comparison key of a text: itself, or lower case when case must not matter."""
    return text if case_sensitive else F.lower(text)


def is_named(text: Column, generic: Sequence[str], case_sensitive: bool = False) -> Column:
    """True unless the text is one of the generic names; NULL counts as named."""
    names = list(generic) if case_sensitive else [g.lower() for g in generic]
    return text.isNull() | ~fold(text, case_sensitive).isin(names)


def without_rank_prefix(label: Column) -> Column:
    """``"3. Suburban Sprawl"`` becomes ``"Suburban Sprawl"``; others are unchanged."""
    return F.when(F.contains(label, F.lit(". ")), F.split_part(label, F.lit(". "), F.lit(2))).otherwise(label)


def wrapped_label(label: Column) -> Column:
    """Chart label: no rank prefix and a line break before the parenthesis."""
    return F.replace(without_rank_prefix(label), F.lit(" ("), F.lit("\n("))


def count_label(count: Column, percent: Column) -> Column:
    """``12,345 claims`` over ``(67.8%)``."""
    return F.concat(
        F.format_number(count, 0),
        F.lit(" claims\n("),
        F.round(percent, 1).cast("decimal(6,1)").cast("string"),
        F.lit("%)"),
    )


def cause_label(code: Column, labels: dict[str, str], otherwise: str) -> Column:
    """Readable name of a code; codes without an entry take ``otherwise``."""
    out = F.lit(otherwise)
    for value, label in labels.items():
        out = F.when(code == value, F.lit(label)).otherwise(out)
    return out
