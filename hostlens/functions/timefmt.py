"""Time text helpers.

Inside plans timestamps stay typed; text is produced only at output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The output text format of normalised timestamps and the
# formats of the JSON row writer.
OUTPUT_FORMAT = "MM/dd/yyyy HH:mm:ss"
JSON_TIMESTAMP_FORMAT = "MM-dd-yyyy HH:mm:ss"
JSON_DATE_FORMAT = "yyyy-MM-dd"

# The clock text of devices: time, zone, weekday, date.
DEVICE_CLOCK = r"^[*.]?(\d{1,2}:\d{2}:\d{2})(?:\.\d+)? (\w+) \w{3} (\w{3} \d{1,2} \d{4})$"

# Shapes of dates, each with the groups that are its year, month and day, and what may follow one: a
# time of day with seconds, fractions (left out) and AM / PM, and a zone.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +)?"
_MONTH = rf"({'|'.join(MONTHS)})[a-z]*\.?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?: ?([ap]m))?"
_ZONE = r"(?: *(z|utc|gmt|[+-]\d{2}:?\d{2}))?"
SHAPES = (
    (r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", 1, 2, 3),
    (r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", 3, 1, 2),
    (r"(\d{4})(\d{2})(\d{2})", 1, 2, 3),
    (rf"{_WEEKDAY}{_MONTH} +(\d{{1,2}}),? +(\d{{4}})", 3, 1, 2),
    (rf"{_WEEKDAY}(\d{{1,2}})[ -]{_MONTH}[ -](\d{{4}})", 3, 2, 1),
)
#: Shapes that Spark's own parser reads fast.
COMMON = (
    (r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}\.\d{3}$", "MM/dd/yyyy HH:mm:ss.SSS"),
    (r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$", "MM/dd/yyyy HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{6}$", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}$", "yyyy-MM-dd HH:mm:ss.SSS"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
)
#: The clock of Unix tools: the year stands behind the time.
UNIX_CLOCK = rf"(?i)^{_WEEKDAY}{_MONTH} +(\d{{1,2}}) +(\d{{1,2}}:\d{{2}}:\d{{2}}) +(?:[a-z]{{3,4}} +)?(\d{{4}})$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_time(col, formats: Sequence[str] | None = None) -> Column:
    """Text to timestamp_ntz, truncated to the second: by the first matching of ``formats``, or by the
    shapes of ``SHAPES`` and the device and Unix clocks.

    Of two numbers before the year the first is the month, unless only the second can be.  A zone is
    taken to UTC; text without one is as it stands.  Text that has no such shape, or whose date the
    calendar has not, gives null (the caller keeps the raw text).  Typed timestamps pass through (truncated).
    """
    c = F.trim(_c(col))
    if formats is not None:
        return F.date_trunc("second", F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])).cast("timestamp_ntz")
    text = c.cast("string")
    device = F.regexp_replace(F.when(text.rlike(DEVICE_CLOCK), text), DEVICE_CLOCK, "$1 $2 $3")
    # what is met most, by Spark's own parser; the others only where these fail
    known = [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(f))) for shape, f in COMMON]
    known.append(F.try_to_timestamp(device, F.lit("H:mm:ss z MMM d yyyy")))
    return F.coalesce(F.date_trunc("second", F.coalesce(*known)).cast("timestamp_ntz"), _shaped(text))


def _shaped(text: Column) -> Column:
    """The time of a text of one of ``SHAPES``: first put into one form, then taken apart."""
    plain = F.when(text.rlike(UNIX_CLOCK), F.regexp_replace(text, UNIX_CLOCK, "$1 $2 $4 $3")).otherwise(text)
    form = F.lit(None).cast("string")
    for date, year, month, day in reversed(SHAPES):
        whole = rf"(?i)^{date}(?:(?:[ ,]+|t){_TIME}{_ZONE})?$"
        form = F.when(plain.rlike(whole), F.regexp_replace(plain, whole, f"${year}|${month}|${day}|$4|$5|$6|$7|$8")).otherwise(form)
    # bound once, and out of the generated code of the common path
    return F.get(F.transform(F.array(F.split(F.lower(form), "[|]")), _made), F.lit(0))


def _made(part: Column) -> Column:
    """The time of (year, month, day, hour, minute, second, AM / PM, zone); null of null."""
    number = lambda i: part[i].try_cast("int")
    first = F.coalesce(number(1), F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part[1]).cast("int"))
    swapped = (first > 12) & (number(2) <= 12)
    half, hour = part[6], F.coalesce(number(3), F.lit(0))
    hour = F.when(half == "", hour).when((hour < 1) | (hour > 12), None).otherwise(hour % 12 + F.when(half == "pm", 12).otherwise(0))
    at = F.try_make_timestamp_ntz(number(0), F.when(swapped, number(2)).otherwise(first), F.when(swapped, first).otherwise(number(2)),
                                  hour, F.coalesce(number(4), F.lit(0)), F.coalesce(number(5), F.lit(0)))
    zone = F.regexp_replace(part[7], ":", "")
    minutes = F.coalesce(F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int"), F.lit(0))
    return at - F.make_dt_interval(mins=F.when(zone.startswith("-"), -minutes).otherwise(minutes))


def normalize_time_text(col, formats: Sequence[str] | None = None,
                        out_format: str = OUTPUT_FORMAT) -> Column:
    """Parse, drop fractions, print ``MM/dd/yyyy HH:mm:ss``; unparsable text kept as is."""
    c = _c(col)
    return F.coalesce(F.date_format(parse_time(c, formats), out_format), c.cast("string"))


def time_losses(df: DataFrame, col: str, formats: Sequence[str] | None = None) -> DataFrame:
    """(n_rows, n_unparsed, example): how much time text no format reads, which a time range would leave out."""
    lost = F.col(col).isNotNull() & (F.trim(F.col(col).cast("string")) != "") & parse_time(F.col(col), formats).isNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(lost).alias("n_unparsed"),
                  F.min(F.when(lost, F.col(col).cast("string"))).alias("example"))


def time_text(col, fmt: str = "yyyy-MM-dd HH:mm:ss.SSSSSS") -> Column:
    """Stable text of a timestamp for output."""
    return F.date_format(_c(col), fmt)
