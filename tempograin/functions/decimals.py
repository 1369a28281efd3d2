"""Exact decimals: parsing, digit limits, the shortest decimal of a float, and physical encodings without silent loss."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most digits of a stored value in plain notation.
MOST_DIGITS = 1024
PLAIN = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
#: Encodings in the order in which they are recommended.
ENCODINGS = ("f32", "f64", "scaled_i64", "scaled_i128", "decimal128", "text")


def shortest(value: Column, precision: int = 38, scale: int = 18) -> Column:
    """A double as the decimal of its shortest round-trip text; an error if that doesn't fit."""
    return value.cast("string").cast(f"decimal({precision},{scale})")


def plain_digits(text: Column) -> Column:
    """Digits of a decimal text written without an exponent."""
    mantissa, power = F.regexp_extract(text, r"^[+-]?([\d.]+)", 1), F.coalesce(F.nullif(F.regexp_extract(text, r"[eE]([+-]?\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    whole = F.length(F.split_part(mantissa, F.lit("."), F.lit(1)))
    part = F.length(F.split_part(mantissa, F.lit("."), F.lit(2)))
    return F.greatest(F.lit(1), whole + F.greatest(power, F.lit(0))) + F.greatest(F.lit(0), part - power) - F.least(F.greatest(power, F.lit(0)), part)


def is_decimal(text: Column) -> Column:
    """Whether a text is a finite decimal within the digit limit."""
    return F.coalesce(text.rlike(PLAIN) & (plain_digits(text) <= MOST_DIGITS), F.lit(False))


def parse_decimal(text: Column, precision: int = 38, scale: int = 18) -> Column:
    """A decimal text as DECIMAL; null for what isn't one or doesn't fit."""
    return F.when(is_decimal(text), text.try_cast(f"decimal({precision},{scale})"))


def encode(value: Column, encoding: str, scale: int = 2) -> Column:
    """A DECIMAL or text value in a physical encoding; null where it doesn't fit at all."""
    if encoding == "f32":
        x = value.try_cast("float")
        return F.when(F.abs(x) != F.lit(float("inf")), x)
    if encoding == "f64":
        x = value.try_cast("double")
        return F.when(F.abs(x) != F.lit(float("inf")), x)
    if encoding == "scaled_i64":
        x = value.try_cast(f"decimal(38,{scale})") * F.lit(Decimal(10**scale))
        return x.try_cast("long")
    if encoding == "scaled_i128":
        return value.try_cast(f"decimal(38,{scale})")
    if encoding == "decimal128":
        return value.try_cast("decimal(38,18)")
    return value.cast("string")


def decode(stored: Column, encoding: str, scale: int = 2) -> Column:
    """The logical value of an encoded one."""
    if encoding in ("f32", "f64"):
        return stored.cast("string").try_cast("decimal(38,18)")
    if encoding == "scaled_i64":
        return (stored.cast("decimal(20,0)") / F.lit(Decimal(10**scale))).cast(f"decimal(38,{scale})")
    return stored.try_cast("decimal(38,18)")


def encoding_error(value: Column, encoding: str, scale: int = 2) -> Column:
    """Absolute error of a value in an encoding; null if it doesn't fit.

    A float stands for its binary value.  That is the decimal itself only if the decimal is a multiple of 2**-18 (at most 18 digits
    follow the point); else the error is at least half a unit in the last place.
    """
    stored = encode(value, encoding, scale)
    v = value.cast("decimal(38,18)")
    if encoding not in ("f32", "f64"):
        return F.abs(v - decode(stored, encoding, scale).cast("decimal(38,18)"))
    x = stored.cast("double")
    near = x.cast("string").try_cast("decimal(38,18)")
    exact = (x * 262_144 == F.floor(x * 262_144).cast("double")) & (near == v)
    return F.when(x.isNull(), F.lit(None)).when(exact, F.lit(0).cast("decimal(38,18)")).otherwise(F.greatest(F.abs(v - near), (F.abs(x) * 2.0**-54).try_cast("decimal(38,18)"), F.lit(1e-18).cast("decimal(38,18)")))


def checked(value: Column, encoding: str, scale: int = 2, tolerance: float = 0.0) -> Column:
    """The encoded value, or an error where it is off by more than the tolerance: nothing is rounded silently."""
    error = encoding_error(value, encoding, scale)
    return F.when(value.isNull() | F.coalesce(error <= F.lit(tolerance), F.lit(False)), encode(value, encoding, scale)).otherwise(F.raise_error(F.concat(F.lit(f"value exceeds the tolerance of {encoding}: "), value.cast("string"))))


def recommend_encoding(df: DataFrame, value: str = "value", tolerance: float = 0.0, scale: int = 2, group: tuple[str, ...] = ()) -> DataFrame:
    """For each group the first encoding whose largest error is within the tolerance, else text; one aggregation over all rows."""
    v = F.col(value)
    fits = {e: F.bool_and(v.isNull() | F.coalesce(encoding_error(v, e, scale) <= F.lit(tolerance), F.lit(False))) for e in ENCODINGS[:-1]}
    out = df.groupBy(*group).agg(*[x.alias(e) for e, x in fits.items()])
    pick = F.lit("text")
    for e in reversed(ENCODINGS[:-1]):
        pick = F.when(F.coalesce(F.col(e), F.lit(True)), F.lit(e)).otherwise(pick)
    return out.select(*group, pick.alias("encoding"))
