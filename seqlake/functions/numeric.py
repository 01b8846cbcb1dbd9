"""Numbers as the sequencing tools print and bin them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = 100.0  # fixed-width histograms cover [0, 100]


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns (in place of such of their names) that are computed once, however much is built on them.

    The optimiser writes a column out wherever a later one uses it, but not through a generator.
    """
    one = F.array(F.struct(*(c.alias(n) for n, c in columns.items())))
    return df.select(*(c for c in df.columns if c not in columns), F.inline_outer(one))


def leading_int(text: Column) -> Column:
    """The integer that a string starts with, or 0."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d{1,18})", 1).try_cast("long"), F.lit(0)).cast("int")


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent32(a: Column, b: Column) -> Column:
    """100 * a / b, narrowed to 32 bits."""
    return (ratio(a, b) * 100).cast("float")


def bin_index(value: Column, width: float) -> Column:
    """Bin of a value of [0, 100] in 32-bit arithmetic; larger values and NaN go to the top bin."""
    v = F.least(value.cast("float"), F.lit(TOP).cast("float"))
    return F.floor((v.cast("double") / F.lit(width).cast("float").cast("double")).cast("float")).cast("int")


def decimals(width: float) -> int:
    """Decimals that a bin width needs: .02 has 2, .0001 has 4."""
    n = 0
    while width < 1 - 1e-9:
        width *= 10
        n += 1
    return n


def bin_edge(index: Column, width: float) -> Column:
    """The lower edge of a bin, rounded to the width's decimals."""
    return F.round((index.cast("float") * F.lit(width).cast("float")).cast("double"), decimals(width))


def c_format(value: float | None, places: int) -> str:
    """Text of a number as C prints it: ties to even of the binary value, `nan` for missing."""
    return "nan" if value is None or value != value else f"{value:.{places}f}"
