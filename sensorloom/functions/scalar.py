"""Column helpers shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character Python's str.strip() removes, so keys trim the same way.
_WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())

_NUMERIC = (T.NumericType, T.BooleanType)


def quoted(name: str) -> Column:
    """Column by exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))


def known(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL (one kind of missing value)."""
    column = quoted(name)
    return F.nanvl(column, F.lit(None)) if is_floating(df, name) else column


def missing(df: DataFrame, name: str) -> Column:
    column = quoted(name)
    return column.isNull() | F.isnan(column) if is_floating(df, name) else column.isNull()


def strip(column: Column) -> Column:
    """Remove leading and trailing whitespace of every kind (``trim`` removes spaces only)."""
    return F.btrim(column.cast("string"), F.lit(_WHITESPACE))


def lenient_number(df: DataFrame, name: str, kind: str = "double") -> Column:
    """Numeric value, or NULL for NaN and for text that is not a number."""
    column = quoted(name)
    data_type = df.schema[name].dataType
    if isinstance(data_type, T.StringType):
        # Java accepts a type suffix ("12f"), which is not a number here.
        column = F.when(~column.rlike(r"[0-9.][dDfF]\s*$"), column)
    elif not isinstance(data_type, _NUMERIC):
        raise TypeError(f"Column {name} of type {data_type.simpleString()} is not numeric.")
    return F.nanvl(column.try_cast("double"), F.lit(None)).cast(kind)


def strict_timestamp(df: DataFrame, name: str, kind: str = "timestamp_ntz") -> Column:
    """Timestamp; text that does not parse fails the job with or without ANSI mode."""
    column = quoted(name)
    if not isinstance(df.schema[name].dataType, T.StringType):
        return column.cast(kind)
    parsed = column.try_cast(kind)
    message = F.concat(F.lit(f"Column {name} holds an invalid timestamp: "), column)
    return F.when(column.isNotNull() & parsed.isNull(), F.raise_error(message)).otherwise(parsed)


def lenient_timestamp(df: DataFrame, name: str, kind: str = "timestamp_ntz") -> Column:
    column = quoted(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return column.try_cast(kind)
    return column.cast(kind)


def strict_flag(df: DataFrame, name: str) -> Column:
    """Label as a byte. Missing or non-numeric values fail; fractions are cut."""
    number = lenient_number(df, name)
    message = F.concat(
        F.lit(f"Label {name} holds a value that is not a small integer: "),
        F.coalesce(quoted(name).cast("string"), F.lit("null")),
    )
    fits = (number > -129) & (number < 128)
    return F.when(fits, number.cast("int").cast("byte")).otherwise(F.raise_error(message).cast("byte"))


def epoch_micros(column: Column) -> Column:
    """Microseconds since the epoch (the session time zone must be UTC)."""
    return F.unix_micros(column.cast("timestamp"))


def iso_text(column: Column) -> Column:
    """ISO-8601 text; microseconds appear only when they are not zero."""
    moment = column.cast("timestamp")
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    exact = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(F.unix_micros(moment) % 1_000_000 == 0, whole).otherwise(exact)


def rounded(column: Column, digits: int | None) -> Column:
    """Round to ``digits``; NULL and NaN give NULL; ``None`` leaves the value as it is.

    The value is first set to nine decimals: a mean differs in its last bit with the order of its
    rows, and where it lies on a tie that bit would decide.
    """
    value = F.nanvl(column.cast("double"), F.lit(None))
    return value if digits is None else F.round(F.round(value, 9), digits)


def finite(column: Column) -> Column:
    value = column.cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def short_number(column: Column) -> Column:
    """Number as text with six significant digits and no trailing zeros."""
    value = column.cast("double")
    scientific = F.format_string("%.5e", value)
    exponent = F.regexp_extract(scientific, r"e(.*)$", 1).cast("int")
    fixed = F.lit(None).cast("string")
    for power in range(-4, 6):
        fixed = F.when(exponent == power, F.format_string(f"%.{5 - power}f", value)).otherwise(fixed)
    trimmed = F.when(fixed.contains("."), F.regexp_replace(fixed, r"\.?0+$", "")).otherwise(fixed)
    compact = F.regexp_replace(scientific, r"\.?0*e", "e")
    return F.when(value == 0, F.lit("0")).otherwise(F.coalesce(trimmed, compact))
