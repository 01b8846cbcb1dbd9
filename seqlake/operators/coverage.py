"""Depth of coverage by a sweep over start and end events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alignment import before, cigar_ops, consumes
from .regions import overlap_join

THRESHOLDS = (1, 5, 10, 20, 30, 40)
BLOCK = 1 << 20


def cigar_stretches(df: DataFrame, *, chrom: str = "chrom", start: str = "start", cigar: str = "cigar", strand: str = "strand") -> DataFrame:
    """(chrom, strand, start, end) of the parts of alignments that match or mismatch bases."""
    return df.select(F.col(chrom).alias("chrom"), F.col(strand).alias("strand"), F.col(start).cast("long").alias("at"), F.col(cigar).alias("cigar")).mapInArrow(_stretches, "chrom string, strand string, start long, end long")


def _stretches(batches):
    """Operations of a batch's CIGARs are taken all at once, so the work grows with their text."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        row, n, op = cigar_ops(b.column("cigar"))
        ahead = before(row, np.where(consumes(op, b"MDN=X"), n, 0))
        some = np.flatnonzero(consumes(op, b"M=X") & (n > 0))
        at = pa.array(row[some])
        first = pc.add(b.column("at").take(at), pa.array(ahead[some]))
        yield pa.RecordBatch.from_arrays([b.column("chrom").take(at), b.column("strand").take(at), first, pc.add(first, pa.array(n[some]))], ["chrom", "strand", "start", "end"])


def depth(df: DataFrame, *, chrom: str = "chrom", start: str = "start", end: str = "end", strand: str | None = None, block: int = BLOCK) -> DataFrame:
    """(chrom, track, start, end, depth): maximal runs of equal depth between the first and last event.

    track is "total", and "fwd" and "rev" if a strand column ("+" or "-") is given. Events at a position are
    summed before they move; the running sum is taken in blocks of positions, each with the sum of
    the blocks before it, so a contig is no single task.
    """
    tracks = F.array(F.lit("total")) if strand is None else F.array(F.lit("total"), F.when(F.col(strand) == "-", "rev").otherwise("fwd"))
    ends = F.array(F.struct(F.col(start).cast("long").alias("pos"), F.lit(1).cast("long").alias("d")), F.struct(F.col(end).cast("long").alias("pos"), F.lit(-1).cast("long").alias("d")))
    ev = df.filter(F.col(start) < F.col(end)).select(F.col(chrom).alias("chrom"), F.explode(tracks).alias("track"), ends.alias("e"))
    ev = ev.select("chrom", "track", F.explode("e").alias("e")).groupBy("chrom", "track", "e.pos").agg(F.sum("e.d").alias("d")).filter("d <> 0")
    ev = ev.withColumn("block", F.floor(F.col("pos") / block))
    along = Window.partitionBy("chrom", "track").orderBy("block")
    blocks = ev.groupBy("chrom", "track", "block").agg(F.sum("d").alias("bd"), F.min("pos").alias("first"))
    blocks = blocks.select("chrom", "track", "block", (F.sum("bd").over(along) - F.col("bd")).alias("base"), F.lead("first").over(along).alias("next"))
    inside = Window.partitionBy("chrom", "track", "block").orderBy("pos")
    out = ev.join(blocks, ["chrom", "track", "block"]).select("chrom", "track", F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(inside), "next").alias("end"), (F.col("base") + F.sum("d").over(inside)).alias("depth"))
    return out.filter(F.col("end").isNotNull())


def in_regions(runs: DataFrame, regions: DataFrame) -> DataFrame:
    """Runs cut to regions, with runs of depth 0 where a region has none: (region columns, r_start, r_end, start, end, depth).

    runs: one track's (chrom, start, end, depth). regions: chrom, r_start, r_end and names; rows are taken as distinct.
    """
    names = regions.columns
    cut = overlap_join(runs.select("chrom", "start", "end", "depth"), regions, key="chrom").select(*names, F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"), "depth")
    # runs are contiguous from the first to the last event, so only ends of a region can be bare
    ends = cut.groupBy(*names).agg(F.min("start").alias("a"), F.max("end").alias("b"))
    bare = regions.join(ends, names, "left").select(*names, F.explode(F.array(
        F.struct(F.col("r_start").alias("start"), F.coalesce("a", "r_end").alias("end")),
        F.struct(F.coalesce("b", "r_end").alias("start"), F.col("r_end").alias("end")),
    )).alias("g")).select(*names, "g.start", "g.end", F.lit(0).cast("long").alias("depth"))
    return cut.unionByName(bare.filter(F.col("start") < F.col("end")))


def bedgraph(runs: DataFrame, regions: DataFrame) -> DataFrame:
    """Depth runs over the regions, restarted at each."""
    return in_regions(runs, regions)


def depth_counts(cut: DataFrame, *by: str) -> DataFrame:
    """Positions at each depth."""
    return cut.groupBy(*by, "depth").agg(F.sum(F.col("end") - F.col("start")).alias("positions"))


def region_summary(cut: DataFrame, *by: str, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """length, bases, mean, min, max of depth, and the share of positions at each threshold or deeper."""
    n = F.col("end") - F.col("start")
    size = F.sum(n)
    share = [F.round(F.coalesce(F.try_divide(F.sum(F.when(F.col("depth") >= t, n).otherwise(0)).cast("double"), size.cast("double")), F.lit(0.0)), 3).alias(f"{t}x") for t in sorted(thresholds)]
    return cut.groupBy(*by).agg(
        size.alias("length"),
        F.sum(F.col("depth") * n).alias("bases"),
        F.round(F.coalesce(F.try_divide(F.sum(F.col("depth") * n).cast("double"), size.cast("double")), F.lit(0.0)), 2).alias("mean"),
        F.min("depth").alias("min"),
        F.max("depth").alias("max"),
        *share,
    )


def summary_with_total(cut: DataFrame, regions: DataFrame, set_name: str, *, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """A row a region, and one for the whole set (start 0, end its positions); overlaps of regions count twice."""
    each = region_summary(cut, "chrom", "r_start", "r_end", thresholds=thresholds).withColumnsRenamed({"r_start": "start", "r_end": "end"})
    total = region_summary(cut, thresholds=thresholds).select(F.lit(set_name).alias("chrom"), F.lit(0).cast("long").alias("start"), F.col("length").alias("end"), *each.columns[3:])
    return each.unionByName(total.filter("length is not null"))


def depth_distribution(cut: DataFrame, *by: str, least: float = 0.001) -> DataFrame:
    """(by, depth, frac): share of positions at each depth or deeper, where it is at least `least`."""
    counts = depth_counts(cut, *by)
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    deeper = F.sum("positions").over(w.orderBy(F.desc("depth")))
    share = (deeper.cast("double") / F.sum("positions").over(w).cast("double")).alias("frac")
    return counts.select(*by, "depth", share).filter(F.col("frac") >= least).withColumn("frac", F.round("frac", 3))
