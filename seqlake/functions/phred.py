"""Mean base qualities. The mean is of error probabilities, in order, and narrowed to 32 bits."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII = 33


def phred_probability(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q.cast("double") / 10)


def quality_udf(offset: int = ASCII, wrap: int = 0):
    """An Arrow UDF: mean quality of a string of quality characters (NaN if empty, null if null).

    wrap: qualities are (code point - offset) modulo wrap, so any text can serve as a quality string.
    """

    @F.arrow_udf("float")
    def mean_quality(quals: pa.Array) -> pa.Array:
        import numpy as np

        table = 10.0 ** (-np.arange(0x200) / 10.0)

        def one(s):
            if s is None:
                return None
            if not s:
                return math.nan
            q = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype("i8") - offset
            q = q % wrap if wrap else np.clip(q, 0, len(table) - 1)
            return 0.0 - 10.0 * math.log10(float(np.add.accumulate(table[q])[-1]) / len(q))

        return pa.array([one(s) for s in quals.to_pylist()], pa.float64()).cast(pa.float32())

    return mean_quality


def mean_quality(quals: Column, offset: int = ASCII, wrap: int = 0) -> Column:
    return quality_udf(offset, wrap)(quals)


def mean_quality_of(values: Column) -> Column:
    """Mean quality of an array of numeric qualities: built-in functions only; NaN if empty or any is 255 (missing)."""
    total = F.aggregate(values, F.lit(0.0), lambda a, q: a + phred_probability(q))
    return F.when((F.size(values) == 0) | F.exists(values, lambda q: q == 255), F.lit(float("nan"))).otherwise(F.lit(0.0) - 10 * F.log10(total / F.size(values))).cast("float")
