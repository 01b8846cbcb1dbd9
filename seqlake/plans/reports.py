"""Whole reports: of read files, and of alignment files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alignment import direction, op_total
from ..functions.comments import with_read_meta
from ..functions.numeric import percent32
from ..functions.phred import mean_quality, mean_quality_of
from ..operators import alignments, coverage, filtering, histogram, summary
from ..operators.filtering import KEPT
from ..sources.fastq import read_fastq


@dataclass
class Reads:
    """DataFrames over one read of the files: keep `records` cached if several are used."""

    records: DataFrame
    kept: DataFrame
    per_read: DataFrame
    per_file: DataFrame
    run_ids: DataFrame
    basecallers: DataFrame
    histograms: DataFrame
    totals: DataFrame = field(default=None)


def reads_report(spark: SparkSession, *paths: str, recursive: bool = False, strict: bool = False, min_length: int = 0, max_length: int = 2**31 - 1, min_quality: float = 0.0, max_dust: float | None = None) -> Reads:
    filtering.check_arguments(max_dust=max_dust, counts=(min_length, max_length))
    raw = read_fastq(spark, *paths, recursive=recursive).withColumnRenamed("file_path", "filename")
    if strict:
        raw = raw.withColumn("status", F.when(~F.col("status").isin(KEPT, "F_FILE_OK"), F.raise_error(F.concat_ws(" ", F.lit("bad input:"), "filename", "status"))).otherwise(F.col("status")))
    read = raw.withColumns({"length": F.length("seq").cast("long"), "quality": mean_quality(F.when(F.col("status") == KEPT, F.col("qual"))), "_read": F.col("status")})
    bounds = {"min_length": min_length, "max_length": max_length, "min_quality": min_quality}
    tested = filtering.with_outcome(read, seq="seq", max_dust=max_dust, **bounds)
    records = tested.withColumn("status", F.when(F.col("_read") == KEPT, F.col("status")).otherwise(F.col("_read"))).drop("_read")
    kept = with_read_meta(records.filter(F.col("status") == KEPT))
    per_read = kept.select(F.col("name").alias("read_id"), "filename", "runid", F.col("length").alias("read_length"), F.round(F.col("quality").cast("double"), 2).alias("mean_quality"), "channel", "read_number", "start_time")
    metrics = {"length": ("length", 0), "quality": ("quality", histogram.WIDTHS["quality"])}
    return Reads(records, kept, per_read, summary.per_file(records), summary.counts_by(kept, "filename", "runid"), summary.counts_by(kept, "filename", "basecaller"), histogram.metric_set(kept, metrics, "ibarcode"), summary.outcome_counts(records))


@dataclass
class Alignments:
    rows: DataFrame
    flagstats: DataFrame
    run_ids: DataFrame
    basecallers: DataFrame
    histograms: DataFrame
    poly_a: DataFrame
    depth: DataFrame
    unmapped_histograms: DataFrame | None = None
    records: DataFrame | None = None


def selected(records: DataFrame, *, read_group: str | None = None, haplotype: int | None = None, tag: tuple[str, int] | None = None, regions: DataFrame | None = None) -> DataFrame:
    """The records that every output of an alignment report sees, coverage among them.

    regions (chr, start, end): only records that overlap one; a record counts once for each region that it overlaps.
    """
    from ..operators.regions import overlap_join

    df = records
    if regions is not None:
        own = regions.select(F.col("chr").alias("ref"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
        placed = df.withColumns({"start": F.col("pos"), "end": F.col("pos") + F.greatest(op_total(F.col("cigar"), "MDN=X"), F.lit(1))})
        df = overlap_join(placed.filter(F.col("ref") != "*"), own, key="ref").drop("start", "end", "r_start", "r_end")
    if read_group is not None:
        df = filtering.by_read_group(df, read_group)
    tag = ("HP", haplotype) if haplotype is not None else tag
    if tag is not None:
        found = F.coalesce(F.col("tags")[tag[0].upper()], F.col("tags")[tag[0].lower()])
        df = df.filter(found["type"].isin(*"cCsSiI") & (found["value"].try_cast("long") == tag[1]))
    return df


def unmapped_histograms(df: DataFrame) -> DataFrame:
    """(metric, bin, count) of lengths and qualities of unmapped reads."""
    metrics = {"length": ("read_length", 0), "quality": ("mean_quality", histogram.WIDTHS["quality"])}
    return histogram.metric_set(df.filter(F.col("flag").bitwiseAND(F.lit(4)) != 0), metrics)


def alignments_report(records: DataFrame, refs: DataFrame, *, unmapped: bool = False, recalculate_quality: bool = False, strict: bool = False, read_group: str | None = None, haplotype: int | None = None, poly_a_reverse: bool = False, tag: tuple[str, int] | None = None, regions: DataFrame | None = None) -> Alignments:
    """records: from read_sam or read_bam. refs: tid, name, length. The rest as for selected()."""
    from ..sources.sam import scalar_tags

    df = selected(scalar_tags(records), read_group=read_group, haplotype=haplotype, tag=tag, regions=regions)
    chosen, depth_rows = df, filtering.covering(df)
    own = mean_quality_of(F.col("qual"))
    # the quality tag is not used for unmapped reads
    quality = own if recalculate_quality else F.coalesce(F.when(F.col("flag").bitwiseAND(F.lit(4)) == 0, F.col("qs")), own)
    df = alignments.with_run(df).withColumns({"name": F.col("qname"), "read_length": F.length("seq").cast("long"), "mean_quality": quality.cast("double"), "start_time": F.coalesce("start_time", F.lit(""))})
    good = alignments.alignment_rows(df, refs, strict=strict)
    rows = good.unionByName(alignments.unmapped_rows(df)) if unmapped else good
    metrics = {"length": ("read_length", 0), "quality": ("mean_quality", histogram.WIDTHS["quality"]), "accuracy": ("acc", histogram.WIDTHS["accuracy"]), "coverage": ("coverage", histogram.WIDTHS["coverage"])}
    tails = df.join(refs.select(F.col("name").alias("ref"), F.col("length").alias("_l")), "ref").filter(F.col("flag").bitwiseAND(F.lit(3844)) == 0)
    tails = tails.withColumn("ref_cover", percent32(op_total(F.col("cigar"), "MDN=X"), F.col("_l")))
    ends = depth_rows.select(F.col("ref").alias("chrom"), direction(F.col("flag")).alias("strand"), F.col("pos").alias("start"), (F.col("pos") + op_total(F.col("cigar"), "MDN=X")).alias("end"))
    return Alignments(
        rows, alignments.flagstats(df, refs, unmapped=unmapped), summary.counts_by(df, "runid"), summary.counts_by(df, "basecaller"),
        histogram.metric_set(good, metrics), histogram.lengths(filtering.poly_a(tails, reverse=poly_a_reverse), "pt"), coverage.depth(ends, strand="strand"),
        unmapped_histograms(df) if unmapped else None, chosen,
    )
