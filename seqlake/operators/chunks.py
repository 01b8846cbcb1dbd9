"""Chunks of an ordered record stream: an index of every n-th record, fetches, rolling files, demultiplexing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE, MOST_SLICES = 4096, 100_000  # rows of a slice, as far as the order column is even; slices of one group at most


def numbered(df: DataFrame, order: str, *by: str) -> DataFrame:
    """df with `ordinal` from 0 by a whole-number order column (distinct within `by`).

    The order column is cut into slices as wide as its range and the number of rows ask for, so sparse numbers
    (places in a file) make no more slices than dense ones. Rows are counted by slice, slices summed up, and rows
    numbered within their slice, so no task sorts a whole group and the sum runs over at most MOST_SLICES rows.
    """
    r = df.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("n")).first()
    slices = max(1, min(MOST_SLICES, r["n"] // SLICE))
    low, width = (r["low"] or 0), max(1, -(-((r["high"] or 0) - (r["low"] or 0) + 1) // slices))
    df = df.withColumn("_slice", F.floor((F.col(order) - low) / width))
    parts = df.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    along = Window.partitionBy(*by).orderBy("_slice") if by else Window.orderBy("_slice")
    parts = parts.withColumn("_before", F.sum("_n").over(along) - F.col("_n")).drop("_n")
    inside = Window.partitionBy(*by, "_slice").orderBy(order)
    return df.join(parts, [*by, "_slice"]).withColumn("ordinal", F.col("_before") + F.row_number().over(inside) - 1).drop("_slice", "_before")


def chunk_index(df: DataFrame, order: str, name: str, *, every: int = 1, offset: str | None = None) -> DataFrame:
    """(chunk_id, file_offset, qname) of every n-th record."""
    at = numbered(df, order)
    return at.filter(F.col("ordinal") % every == 0).select(F.floor(F.col("ordinal") / every).alias("chunk_id"), F.col(offset or order).alias("file_offset"), F.col(name).alias("qname"))


def chunk(df: DataFrame, order: str, chunk_id: int, *, every: int) -> DataFrame:
    """The records of one chunk; none for an id out of range."""
    return numbered(df, order).filter((F.col("ordinal") >= chunk_id * every) & (F.col("ordinal") < (chunk_id + 1) * every)).drop("ordinal")


def rolling_file(df: DataFrame, order: str, by: Sequence[str], *, reads_per_file: int) -> DataFrame:
    """df with file_index: the running file of each group that takes reads_per_file records."""
    return numbered(df, order, *by).withColumn("file_index", F.floor(F.col("ordinal") / reads_per_file)).drop("ordinal")
