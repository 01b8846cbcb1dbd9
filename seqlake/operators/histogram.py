"""Sparse histograms: only bins that count something are rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import bin_edge, bin_index

LENGTH_TOP = 10_000_000
# Bin widths by metric.
WIDTHS = {"quality": 0.02, "accuracy": 0.0001, "coverage": 0.01}


def lengths(df: DataFrame, length: str, *by: str, top: int = LENGTH_TOP) -> DataFrame:
    """(by, lower, upper, count): one bin a length; lengths from `top` on share a bin whose upper edge is 0."""
    n = F.col(length).cast("long")
    low = F.least(n, F.lit(top))
    return df.filter(n.isNotNull()).groupBy(*by, low.alias("lower")).agg(F.count("*").alias("count")).select(*by, "lower", F.when(F.col("lower") < top, F.col("lower") + 1).otherwise(0).alias("upper"), "count")


def grouped_bin(value: Column, groups: Sequence[tuple[int, int]]) -> Column:
    """Lower edge of bins whose width changes: groups of (upper, step); values from the last upper on share a bin."""
    out, low = None, 0
    for upper, step in groups:
        edge = (F.lit(low) + F.floor((value - low) / step) * step).cast("long")
        out = F.when(value < upper, edge) if out is None else out.when(value < upper, edge)
        low = upper
    return out.otherwise(F.lit(low).cast("long"))


def grouped(df: DataFrame, value: str, groups: Sequence[tuple[int, int]], *by: str) -> DataFrame:
    return df.groupBy(*by, grouped_bin(F.col(value), groups).alias("lower")).agg(F.count("*").alias("count"))


def fixed_width(df: DataFrame, value: str, width: float, *by: str) -> DataFrame:
    """(by, lower, upper, count) over [0, 100]."""
    binned = df.filter(F.col(value).isNotNull()).groupBy(*by, bin_index(F.col(value), width).alias("bin")).agg(F.count("*").alias("count"))
    return binned.select(*by, bin_edge(F.col("bin"), width).alias("lower"), bin_edge(F.col("bin") + 1, width).alias("upper"), "count")


def metric_set(df: DataFrame, metrics: dict[str, tuple[str, float]], *by: str) -> DataFrame:
    """(by, metric, bin, count) of several metrics in one scan and one shuffle: {name: (column, width)}, width 0 for lengths."""
    cells = [F.struct(F.lit(m).alias("metric"), (F.least(F.col(c).cast("long"), F.lit(LENGTH_TOP)).cast("int") if not w else bin_index(F.col(c), w)).alias("bin")) for m, (c, w) in metrics.items()]
    return df.select(*by, F.explode(F.array(*cells)).alias("c")).filter("c.bin is not null").groupBy(*by, "c.metric", "c.bin").agg(F.count("*").alias("count"))


def edges(bins: DataFrame, metrics: dict[str, float]) -> DataFrame:
    """(by, metric, lower, upper, count) of metric_set's bins, ordered as they are written; {name: width}, width 0 for lengths."""
    low = high = None
    for name, width in metrics.items():
        here = F.col("metric") == name
        a = F.col("bin").cast("double") if not width else bin_edge(F.col("bin"), width)
        b = F.when(F.col("bin") < LENGTH_TOP, F.col("bin") + 1).otherwise(0).cast("double") if not width else bin_edge(F.col("bin") + 1, width)
        low, high = (F.when(here, a), F.when(here, b)) if low is None else (low.when(here, a), high.when(here, b))
    by = [c for c in bins.columns if c not in ("metric", "bin", "count")]
    return bins.select(*by, "metric", low.alias("lower"), high.alias("upper"), "count").orderBy(*by, "metric", "lower")
