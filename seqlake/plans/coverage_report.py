"""Coverage over sets of regions: tracks by strand, summaries and distributions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alignment import NOT_COVERED, direction, op_total
from ..operators import coverage, filtering, regions


@dataclass
class Coverage:
    """Of one region set: tracks (track, chrom, r_start, r_end, start, end, depth), summary and distribution."""

    name: str
    tracks: DataFrame
    summary: DataFrame
    distribution: DataFrame


def stretches(records: DataFrame, *, by_cigar: bool = False, exclude: int = NOT_COVERED, include: int = 0) -> DataFrame:
    """(chrom, strand, start, end) that alignments cover: all of their reference span, or matched bases only."""
    own = filtering.covering(records, exclude=exclude, include=include).withColumns({"chrom": F.col("ref"), "strand": direction(F.col("flag"))})
    if by_cigar:
        return coverage.cigar_stretches(own, start="pos")
    return own.select("chrom", "strand", F.col("pos").alias("start"), (F.col("pos") + op_total(F.col("cigar"), "MDN=X")).alias("end"))


def region_sets(spark: SparkSession, refs: DataFrame, *, beds: dict[str, str] | None = None, segments: Sequence[int] = ()) -> dict[str, DataFrame]:
    """The whole genome ("genome"), tiles ("segments_N") and BED files by name, cut to the references."""
    sets = {"genome": regions.whole_genome(refs)}
    sets |= {f"segments_{n}": regions.segments(refs, n) for n in segments}
    sets |= {name: regions.clipped(regions.parse_bed(spark.read.text(path)), refs) for name, path in (beds or {}).items()}
    return {k: v.select(F.col("chr").alias("chrom"), F.col("start").alias("r_start"), F.col("end").alias("r_end")).distinct() for k, v in sets.items()}


def coverage_report(records: DataFrame, refs: DataFrame, *, beds: dict[str, str] | None = None, segments: Sequence[int] = (), thresholds: Sequence[int] = coverage.THRESHOLDS, by_strand: bool = True, by_cigar: bool = False, exclude: int = NOT_COVERED, include: int = 0) -> list[Coverage]:
    runs = coverage.depth(stretches(records, by_cigar=by_cigar, exclude=exclude, include=include), strand="strand" if by_strand else None)
    out = []
    for name, own in region_sets(records.sparkSession, refs, beds=beds, segments=segments).items():
        kinds = ("total", "fwd", "rev") if by_strand else ("total",)
        cut = {k: coverage.in_regions(runs.filter(F.col("track") == k).drop("track"), own) for k in kinds}
        tracks = None
        for k, df in cut.items():
            df = df.withColumn("track", F.lit(k))
            tracks = df if tracks is None else tracks.unionByName(df)
        out.append(Coverage(name, tracks, coverage.summary_with_total(cut["total"], own, name, thresholds=thresholds), coverage.depth_distribution(cut["total"]).select(F.lit(name).alias("name"), "depth", "frac")))
    return out
