"""Forgiving casts for raw text cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK_POLICIES = ("null", "zero")
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T].*)?$"
_WIDE = "decimal(38,10)"


def _bounds(dtype: T.DataType) -> tuple[str, str]:
    """Least and greatest value of a numeric type, as text."""
    if isinstance(dtype, T.DecimalType):
        nines = "9" * (dtype.precision - dtype.scale)
        most = f"{nines or '0'}.{'9' * dtype.scale}" if dtype.scale else nines
        return f"-{most}", most
    bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}[type(dtype)]
    return str(-(1 << (bits - 1))), str((1 << (bits - 1)) - 1)


def _number(text: Column, dtype: T.DataType) -> Column:
    """A whole cell that is a number, rounded half away from zero; NULL if it does not fit."""
    if isinstance(dtype, T.IntegralType):
        return F.round(text.try_cast(_WIDE), 0).try_cast(dtype)
    return text.try_cast(dtype)


def _leading_number(text: Column, dtype: T.DataType) -> Column:
    """The number a cell begins with, 0 if none, drawn back to the nearest value that fits."""
    if isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType):
        return F.coalesce(F.nullif(F.regexp_extract(text, _NUMBER, 0), F.lit("")).try_cast(dtype), F.lit(0).cast(dtype))
    least, most = (F.lit(x) for x in _bounds(dtype))
    scale = dtype.scale if isinstance(dtype, T.DecimalType) else 0

    def stored(found: Column) -> Column:
        size = found.try_cast("double")
        # Digits beyond the widest decimal are out of range for every type, but for tiny exponents.
        wide = F.coalesce(F.round(found.try_cast(_WIDE), scale), F.when(size < 0, least).otherwise(most).cast(_WIDE))
        drawn = F.greatest(F.least(wide, most.cast(_WIDE)), least.cast(_WIDE)).try_cast(dtype)
        nothing = found.isNull() | (found == "")
        return F.when(nothing | (F.abs(size) < 1e-10), F.lit(0).cast(dtype)).otherwise(drawn)

    # A lambda binds the match, which else is made again at each of its uses, in code so long for a few
    # columns that it is never compiled.
    return F.transform(F.array(F.regexp_extract(text, _NUMBER, 0)), stored)[0]


def lenient(cell: Column, dtype: T.DataType, blank_numeric: str = "null") -> Column:
    """Cast raw text, in one of two ways for numbers.

    Whole numbers round a decimal point away, half away from zero: ``3.0`` is 3, ``1234.56``
    is 1235. With ``blank_numeric="null"`` a numeric cell that is empty, no number as a whole
    or out of range is NULL. With ``"zero"`` it is what a lenient SQL loader stores: the
    number the cell begins with (``12abc`` is 12), 0 if it begins with none, and the nearest
    value the type holds if it is out of range. Flags that cannot be read are NULL or false.

    Dates need the shape year-month-day; impossible ones such as ``0000-00-00`` are NULL.
    """
    if blank_numeric not in BLANK_POLICIES:
        raise ValueError(f"blank_numeric must be one of {BLANK_POLICIES}, not {blank_numeric!r}")
    if isinstance(dtype, T.StringType):
        return cell
    text = F.trim(cell)
    if isinstance(dtype, T.NumericType):
        return _leading_number(text, dtype) if blank_numeric == "zero" else _number(text, dtype)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.when(text.rlike(_DATE), text.try_cast(dtype))
    value = text.try_cast(dtype)
    if blank_numeric == "zero" and isinstance(dtype, T.BooleanType):
        value = F.coalesce(value, F.lit(False))
    return value
