"""I4: heading normalisation (plan-time renames)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

_BETWEEN_UNDERSCORES = re.compile(r"[^_]+")


def heading(name: str, title: bool = True) -> str:
    """The column name for people: every underscore becomes a space and, with ``title``,
    words get title case.  Words without a lower-case letter (``CPU``, ``2G``) stay as they are."""
    def cased(word: re.Match) -> str:
        text = word.group()
        return text.title() if any(c.islower() for c in text) else text

    if title:
        name = _BETWEEN_UNDERSCORES.sub(cased, name)
    return name.replace("_", " ")


def normalize_headings(df: DataFrame, title: bool = True) -> DataFrame:
    """``df`` with normalised column names."""
    return df.withColumnsRenamed({c: heading(c, title) for c in df.columns})
