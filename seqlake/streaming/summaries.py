"""Per-file summaries of records that keep arriving: the batch aggregates on a stream.

State is a row a file (or a key), whatever the number of records. With a timestamp column and a delay,
windows close and leave the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.summary import counts_by, per_file


def stream_per_file(records: DataFrame, **columns) -> DataFrame:
    """Streaming form of summary.per_file; write with outputMode("complete") or "update"."""
    return per_file(records, **columns)


def stream_counts(records: DataFrame, *by: str) -> DataFrame:
    return counts_by(records, *by)


def windowed_counts(records: DataFrame, *by: str, time: str, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(start, by, count) of tumbling windows; rows later than the delay are dropped. Write with outputMode("append")."""
    own = records.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), *by).agg(F.count("*").alias("count"))
    return own.select(F.col("w.start").alias("start"), *by, "count")


def run_available(df: DataFrame, name: str, checkpoint: str, *, mode: str = "complete"):
    """Process all that is there, then stop; the result is the in-memory table `name`."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
