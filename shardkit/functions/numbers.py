"""Weights as text, numbers as text and one-decimal percentages."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whole number, then anything; the rest is the unit.
WEIGHT_RE = r"(?s)^(\d+)(.*)$"

# White space, also beyond ASCII.
SPACES = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# The number a text starts with.
LEADING_NUMBER_RE = rf"^[{SPACES}]*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"


# Doubles from here on, and below the other, are written with an exponent.
_LARGE, _SMALL = 1e21, 1e-16


def number_text(col: Column, dtype: T.DataType) -> Column:
    """Text of a value, without trailing zeros for fractional types, and without exponent but for very large and very small doubles."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        size = F.abs(col.cast("double"))
        plain = F.when((size < _LARGE) & ((size >= _SMALL) | (size == 0)), col)
        digits = _without_zeros(plain.cast("decimal(38,16)").cast("string"), plain)
        # 1.0E30 is 1e+30, 1.5E-20 is 1.5e-20; infinite values and NaN are as they are
        far = F.regexp_replace(F.lower(col.cast("double").cast("string")), r"(\.0)?e(?=\d)", "e+")
        far = F.regexp_replace(far, r"\.0(?=e)", "")
        return F.coalesce(digits, F.when(size < float("inf"), far).otherwise(col.cast("string")))
    text = col.cast("string")
    if isinstance(dtype, T.DecimalType) and dtype.scale > 0:
        text = _without_zeros(text, col)
    return text


def _without_zeros(text: Column, number: Column) -> Column:
    return F.when(number == 0, F.lit("0")).otherwise(F.regexp_replace(text, r"\.?0+$", ""))


def weight_text(col: Column, dtype: T.DataType) -> Column:
    """Text of a weight column; a missing value and the number zero are empty."""
    text = F.coalesce(number_text(col, dtype), F.lit(""))
    if isinstance(dtype, T.NumericType):
        return F.when(col == 0, F.lit("")).otherwise(text)
    return text


def parse_weight(text: Column) -> Column:
    """Text such as '12 MB' as struct<weight BIGINT, unit STRING>.

    Text that does not start with a digit weighs 0 and has no unit. Numbers
    beyond BIGINT fail rather than turn into something else.
    """
    text = F.coalesce(text, F.lit(""))
    matches = text.rlike(WEIGHT_RE)
    rest = F.regexp_extract(text, WEIGHT_RE, 2)
    unit = F.regexp_replace(rest, f"^[{SPACES}]+|[{SPACES}]+$", "")
    number = F.regexp_extract(text, WEIGHT_RE, 1).cast("bigint")
    weight = F.when(matches, number).otherwise(F.lit(0).cast("bigint"))
    return F.struct(weight.alias("weight"), F.when(matches, unit).alias("unit"))


def leading_number(text: Column) -> Column:
    """The number a text starts with, as DECIMAL; null when there is none."""
    digits = F.regexp_extract(text, LEADING_NUMBER_RE, 1)
    return F.nullif(digits, F.lit("")).try_cast("decimal(38,10)")


def leading_double(text: Column) -> Column:
    """The number a text starts with, as DOUBLE, of any size; null when there is none."""
    digits = F.regexp_extract(text, LEADING_NUMBER_RE, 1)
    return F.nullif(digits, F.lit("")).try_cast("double")


def percent_text(ratio: Column) -> Column:
    """Percentage of a ratio in 0..1 with one decimal, halves rounded up.

    Works on the exact binary value of ratio * 100, scaled to an integer, as
    rounding its decimal form would turn 1.45 (a little below) into 1.5.
    """
    pct = ratio * F.lit(100.0)
    tenths = F.when(pct < 1.0, _tenths(pct, 57)).otherwise(_tenths(pct, 52))
    return F.concat(
        F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%")
    )


def _tenths(pct: Column, bits: int) -> Column:
    # floor(pct * 10 + 1/2), with pct = scaled / 2^bits; stays below 2^63 for pct <= 100
    scaled = (pct * F.lit(float(1 << bits))).cast("bigint")
    return F.shiftright(scaled * 20 + F.lit(1 << bits), bits + 1)
