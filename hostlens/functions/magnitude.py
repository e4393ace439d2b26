"""Q14: readable magnitude of an integer (``2.4G``) as a column expression.

Decimal places are chosen from the magnitude as the reference does; the
quotient is rounded as C-style ``%.Nf`` formatting rounds the binary double
``x / base**k``: to nearest, where an exact decimal tie is settled by the side
of the tie the double actually lies on (an error-free product tells), and an
exact binary tie goes to even.  All of it is plain arithmetic in generated
code.  Floats are truncated to bigint, null gives null.  ``chart`` is the form
that chart labels use: magnitudes to the base 10.24, divided by powers of 1000.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Unit suffixes and the cut-over magnitude.
SUFFIXES = ["", "K", "M", "G", "T", "P"]
MAX_MAGNITUDE = 16


def add_magnitude(df: DataFrame, col, out: str, base: int = 1000, three_digit: bool = False,
                  chart: bool = False) -> DataFrame:
    """Add column ``out`` with the readable magnitude of ``col``.

    Built in stages (one column per step) so that shared sub-expressions are
    computed once and the generated code stays small.
    """
    src = F.col(col) if isinstance(col, str) else col
    x = src.try_cast("double").try_cast("bigint")
    t = "_mg_"
    d = df.withColumn(t + "x", x).withColumn(t + "ax", F.abs(F.col(t + "x").cast("decimal(38,0)")))
    if base == 1024 or chart:
        mag = F.floor(F.log(F.abs(F.col(t + "x")).cast("double")) / F.log(F.lit(10.24))).cast("int")
    else:
        mag = (F.length(F.col(t + "ax").cast("string")) - 1).cast("int")
    d = d.withColumn(t + "mag", mag)
    m = F.col(t + "mag")
    if three_digit:
        illion = F.floor(m / 3).cast("int")
        places = F.when(F.pmod(m, F.lit(3)) == 0, F.lit(2)).otherwise(F.lit(1))
    else:
        illion = F.floor((m + 1) / 3).cast("int")
        places = F.when(F.pmod(m, F.lit(3)) == 1, F.lit(1)).otherwise(F.lit(2))
    d = (d.withColumn(t + "ill", illion).withColumn(t + "pl", places)
         .withColumn(t + "den", F.pow(F.lit(base), F.col(t + "ill")).cast("decimal(38,0)"))
         .withColumn(t + "sc", F.when(F.col(t + "pl") == 1, F.lit(10)).otherwise(F.lit(100)).cast("decimal(38,0)"))
         .withColumn(t + "n", (F.col(t + "ax") * F.col(t + "sc")).cast("decimal(38,0)")))
    d = d.withColumn(t + "q0", F.floor(F.col(t + "n") / F.col(t + "den")).cast("decimal(38,0)"))
    d = d.withColumn(t + "r", (F.col(t + "n") - F.col(t + "q0") * F.col(t + "den")).cast("decimal(38,0)"))
    # which side of the tie (2 q0 + 1) / (2 sc) the double x / den lies on: the double times 2 sc is
    # taken apart into two products without rounding (Dekker), so the sign of the difference is exact
    dbl = F.col(t + "ax").cast("double") / F.col(t + "den").cast("double")
    d = d.withColumn(t + "dbl", dbl).withColumn(t + "split", F.col(t + "dbl") * F.lit(134217729.0))
    high = F.col(t + "split") - (F.col(t + "split") - F.col(t + "dbl"))
    d = d.withColumn(t + "high", high).withColumn(t + "two", (F.col(t + "sc") * 2).cast("double"))
    d = d.withColumn(t + "off", (F.col(t + "high") * F.col(t + "two") - (F.col(t + "q0") * 2 + 1).cast("double"))
                     + (F.col(t + "dbl") - F.col(t + "high")) * F.col(t + "two"))
    tie = F.col(t + "r") * 2 == F.col(t + "den")
    above, equal = F.col(t + "off") > 0, F.col(t + "off") == 0
    up = ((F.col(t + "r") * 2 > F.col(t + "den")) |
          (tie & (above | (equal & (F.pmod(F.col(t + "q0"), F.lit(2)) == 1)))))
    d = d.withColumn(t + "q", (F.col(t + "q0") + F.when(up, F.lit(1)).otherwise(F.lit(0))).cast("decimal(38,0)"))
    d = d.withColumn(t + "w", F.floor(F.col(t + "q") / F.col(t + "sc")).cast("decimal(38,0)"))
    frac = (F.col(t + "q") - F.col(t + "w") * F.col(t + "sc")).cast("bigint").cast("string")
    fixed = F.concat(F.col(t + "w").cast("string"), F.lit("."), F.lpad(frac, F.col(t + "pl"), "0"))
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), F.col(t + "ill") + 1)
    sign = F.when(F.col(t + "x") < 0, F.lit("-")).otherwise(F.lit(""))
    big_den = F.lit(base ** 5).cast("decimal(38,0)")
    big = F.concat(sign, F.floor(F.col(t + "ax") / big_den).cast("decimal(38,0)").cast("string"), F.lit("P"))
    value = (F.when(F.col(t + "x").isNull(), F.lit(None).cast("string"))
             .when(F.col(t + "x") == 0, F.lit("0"))
             .when(m > MAX_MAGNITUDE, big)
             .otherwise(F.concat(sign, fixed, suffix)))
    return d.withColumn(out, value).drop(*[c for c in d.columns if c.startswith(t)])
