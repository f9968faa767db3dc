"""Value view: how any typed column becomes the stripped string the rules are learned on."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Spellings of infinity that count as numbers.
INFINITIES = ["inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"]


def as_text(col: Column, dtype: T.DataType = T.StringType()) -> Column:
    """Null (and NaN) become the empty string; everything else a stripped string.

    Both zeros have one text, as they are one value when grouped or joined."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = F.when(col == 0, F.lit("0.0")).when(~F.isnan(col), col.cast("string"))
    elif isinstance(dtype, T.BinaryType):
        text = F.hex(col)
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(col)
    else:
        text = col.cast("string")
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        text = F.trim(text, F.lit(WHITESPACE))
    return F.coalesce(text, F.lit(""))


def as_number(col: Column) -> Column:
    """String to double; text that is not a plain number becomes null.

    Spark's own cast also accepts ``1.0f``, hexadecimal floats and ``NaN``; the character
    test keeps those out.
    """
    plain = F.when(col.rlike("^[0-9.eE+-]+$"), col.try_cast("double"))
    special = F.when(F.lower(col).isin(INFINITIES), col.try_cast("double"))
    return F.coalesce(plain, special)


def number_of(col: Column, dtype: T.DataType) -> Column:
    """Number of a typed column, always the number its text shows.

    Integers, decimals and doubles give that number by a cast; a float's cast would show digits
    its text has not, so it is read from the text."""
    if isinstance(dtype, T.DoubleType):
        return F.when(col == 0, F.lit(0.0)).when(~F.isnan(col), col)
    if isinstance(dtype, (T.IntegralType, T.DecimalType)):
        return col.cast("double")
    return as_number(as_text(col, dtype))


def num_name(column: str) -> str:
    return f"__num_{column}"


def number_in(rows: DataFrame, column: str) -> Column:
    """The number of a text column of ``rows``: its typed companion if ``rows`` carries one."""
    typed = num_name(column)
    return F.col(f"`{typed}`") if typed in rows.columns else as_number(F.col(f"`{column}`"))


def finite(col: Column) -> Column:
    """Null for infinities, the number otherwise."""
    return F.when(F.abs(col) < F.lit(float("inf")), col)


def round_even(col: Column, digits: int) -> Column:
    return F.bround(col, digits)


def value_view(df: DataFrame, columns: list[str] | None = None, keep: str | None = None) -> DataFrame:
    """All ``columns`` as normalized strings in one projection; ``keep`` passes through."""
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = columns if columns is not None else [c for c in df.columns if c != keep]
    out = [] if keep is None else [F.col(f"`{keep}`")]
    out += [as_text(F.col(f"`{c}`"), types[c]).alias(c) for c in columns]
    return df.select(*out)


def number_view(df: DataFrame, columns: list[str], keep: str | None = None) -> DataFrame:
    """Double view of text columns (null where a value does not parse)."""
    out = [] if keep is None else [F.col(f"`{keep}`")]
    return df.select(*out, *[as_number(F.col(f"`{c}`")).alias(c) for c in columns])
