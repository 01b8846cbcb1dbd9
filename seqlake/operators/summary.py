"""Summaries by file: counts, outcomes, run ids and basecallers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filtering import CODES, KEPT


def outcome_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by, "status").agg(F.count("*").alias("count"))


def per_file(df: DataFrame, file: str = "filename", *, length: str = "length", quality: str = "quality", files: DataFrame | None = None) -> DataFrame:
    """One row a file: survivors' count, bases, least and greatest length, unweighted mean quality, and each code's count.

    R_RECORD_OK counts every record that was read, filtered or not. Files without records appear if `files` names them.
    """
    ok = F.col("status") == KEPT
    read = F.when(F.col("status").startswith("R_"), 1).otherwise(0)
    code = [(F.sum(read) if c == KEPT else F.sum((F.col("status") == c).cast("int"))).cast("long").alias(c.lower()) for c in CODES]
    out = df.groupBy(file).agg(
        F.sum(ok.cast("long")).alias("n_seqs"),
        F.coalesce(F.sum(F.when(ok, F.col(length).cast("long"))), F.lit(0)).alias("n_bases"),
        F.coalesce(F.min(F.when(ok, F.col(length).cast("long"))), F.lit(0)).alias("min_length"),
        F.coalesce(F.max(F.when(ok, F.col(length).cast("long"))), F.lit(0)).alias("max_length"),
        F.coalesce(F.round(F.avg(F.when(ok, F.col(quality).cast("double"))), 2), F.lit(0.0)).alias("mean_quality"),
        *code,
    )
    if files is None:
        return out
    return files.select(file).distinct().join(out, file, "left").na.fill(0)


def grand_total(df: DataFrame, by: str) -> DataFrame:
    """Outcome counts by file and status, with a row of totals (null file) a status."""
    return df.groupBy("status", by).agg(F.count("*").alias("n")).groupBy("status", by).agg(F.sum("n").alias("n")).rollup("status", by).agg(F.sum("n").alias("count")).filter(F.col("status").isNotNull())


def counts_by(df: DataFrame, *by: str) -> DataFrame:
    """Counter of a key a file; null keys count as the empty string."""
    named = [F.coalesce(F.col(c), F.lit("")).alias(c) if dict(df.dtypes)[c] == "string" else F.col(c) for c in by]
    return df.groupBy(*named).agg(F.count("*").alias("count"))
