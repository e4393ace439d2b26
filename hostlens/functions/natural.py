"""O1-O3: natural sort keys as column expressions.

A value becomes one text whose plain order is the natural order: each piece of
the value is encoded so that pieces compare by value, and the codes are put
one after the other.  Outer spaces are trimmed.  A value that as a whole is a
signed, decimal or exponent number is one number; otherwise the runs of digits
are numbers and what stands between them is text.  The order of pieces is

    blank text < negative number < end of the value < digits that start with 0
    (by text) < positive number < other text

Numbers are compared exactly, by the place of their first digit and their
digits, so there is no overflow.  As the key is a plain text, it works in
``orderBy`` and in range partitioning, and a prefix of it bounds its width.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as one number or one hexadecimal number as a whole.
WHOLE_NUMBER = r"(?i)^-?[0-9]+(\.?[0-9]*)[df]?e?[0-9]?%?$"
WHOLE_HEX = r"(?i)^0x[0-9a-f]+$"
_STOP = "\x01"      # ends a text; sorts before any character of it
_OFFSET = 50_000_000


def _number(t: Column) -> Column:
    """Code of a number text that does not start with 0: the place of its first digit, then its digits."""
    whole = F.regexp_extract(t, r"^-?([0-9]+)", 1)
    part = F.regexp_extract(t, r"^-?[0-9]+\.([0-9]*)", 1)
    power = F.coalesce(F.regexp_extract(t, r"(?i)^-?[0-9]+(?:\.[0-9]*)?e([0-9])", 1).try_cast("int"), F.lit(0))
    digits = F.regexp_replace(F.concat(whole, part), "^0+", "")
    place = F.length(whole) + power - (F.length(whole) + F.length(part) - F.length(digits)) + _OFFSET
    code = F.concat(F.lpad(place.cast("string"), 9, "0"), F.regexp_replace(digits, "0+$", ""))
    down = F.concat(F.lit("b"), F.translate(code, "0123456789", "9876543210"), F.lit("~"))
    return F.when(digits == "", F.concat(F.lit("d"), t, F.lit(_STOP))).when(t.startswith("-"), down) \
        .otherwise(F.concat(F.lit("e"), code, F.lit(_STOP)))


def _piece(t: Column) -> Column:
    return (F.when(t.startswith("0"), F.concat(F.lit("d"), t, F.lit(_STOP)))
            .when(t.rlike("^-?[0-9]"), _number(t))
            .when(t.rlike(r"^\s*$"), F.concat(F.lit("a"), t, F.lit(_STOP)))
            .otherwise(F.concat(F.lit("f"), t, F.lit(_STOP))))


def natural_key(col, strip_html: bool = False, case_insensitive: bool = False) -> Column:
    """The sort key of a text column; null sorts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    if strip_html:
        c = F.regexp_replace(c, r"<[^>]+>", "")
    if case_insensitive:
        c = F.lower(c)
    pieces = F.when(c.rlike(WHOLE_NUMBER) | c.rlike(WHOLE_HEX), F.array(c)).otherwise(
        F.regexp_extract_all(c, F.lit(r"([0-9]+|[^0-9]+)"), 1))
    return F.concat(F.array_join(F.transform(pieces, _piece), ""), F.lit("c"))
