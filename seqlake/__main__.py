"""python -m seqlake reads|lint|alignments|coverage|index: the report programs on a local or given session."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqlake")
    sub = top.add_subparsers(dest="command", required=True)
    r = sub.add_parser("reads", help="filter, describe, split and convert read files")
    r.add_argument("paths", nargs="+", help="files or folders; - reads a list of paths")
    for name, kind, default in (("min_length", int, 0), ("max_length", int, 2**31 - 1), ("min_quality", float, 0.0), ("max_dust", float, None), ("reads_per_file", int, None)):
        r.add_argument(f"--{name}", type=kind, default=default)
    r.add_argument("--recurse", action="store_true")
    r.add_argument("--force_error", action="store_true")
    r.add_argument("--reheader", action="store_true", help="write comments as SAM tags")
    r.add_argument("--sample")
    for name in ("output", "bam", "demultiplex", "read", "file", "runids", "basecallers", "histograms"):
        r.add_argument(f"--{name}", help="folder to write to")
    x = sub.add_parser("lint", help="drop low-complexity reads")
    x.add_argument("paths", nargs="+")
    x.add_argument("--max_proportion", type=float, default=0.95)
    x.add_argument("--output", required=True)
    for p in (sub.add_parser("alignments", help="describe alignments"), sub.add_parser("coverage", help="depth of coverage")):
        p.add_argument("path")
        p.add_argument("--output", required=True, help="folder to write to")
        p.add_argument("--bed", action="append", default=[], help="name=path")
        p.add_argument("--segments", type=int, nargs="*", default=[])
        p.add_argument("--thresholds", type=int, nargs="*")
        p.add_argument("--refs", help="SAM text whose header names the references (BAM input)")
        if p.prog.endswith("alignments"):
            p.add_argument("--region")
            p.add_argument("--sample")
            p.add_argument("--unmapped", action="store_true")
            p.add_argument("--recalc_qual", action="store_true")
            p.add_argument("--read_group")
            p.add_argument("--haplotype", type=int)
            p.add_argument("--tag_name")
            p.add_argument("--tag_value", type=int)
            p.add_argument("--poly_a_rev", action="store_true")
    i = sub.add_parser("index", help="chunk index of a BAM file").add_subparsers(dest="mode", required=True)
    b = i.add_parser("build")
    b.add_argument("bam")
    b.add_argument("index")
    b.add_argument("--chunk_size", type=int, default=1)
    f = i.add_parser("fetch")
    f.add_argument("bam")
    f.add_argument("index")
    f.add_argument("output")
    f.add_argument("--chunk", type=int, required=True)
    i.add_parser("dump").add_argument("index")
    return top


def reads(spark: SparkSession, a) -> None:
    from .plans.reports import reads_report
    from .sources import sam, sinks

    paths = [p for given in a.paths for p in ((s.rstrip("\r\n") for s in sys.stdin) if given == "-" else [given])]
    rep = reads_report(spark, *paths, recursive=a.recurse, strict=a.force_error, min_length=a.min_length, max_length=a.max_length, min_quality=a.min_quality, max_dust=a.max_dust)
    comment = "tags" if a.reheader else "comment"
    if a.output:
        (sinks.reheadered(rep.kept).write.text(a.output) if a.reheader else sinks.write_fastq(rep.kept, a.output, gzip=False))
    if a.bam:
        sam.write_bam(sam.unaligned(rep.kept), a.bam)
    if a.demultiplex:
        sinks.write_demultiplexed(rep.kept, a.demultiplex, comment=comment, reads_per_file=a.reads_per_file)
    for path, df, after, places in ((a.read, rep.per_read, "runid", {"mean_quality": 2}), (a.file, rep.per_file, "filename", {"mean_quality": 2}), (a.runids, rep.run_ids, "filename", None), (a.basecallers, rep.basecallers, "filename", None), (a.histograms, rep.histograms, "metric", None)):
        if path:
            sinks.write_table(df, path, sample=a.sample, after=after, places=places)
    for row in rep.totals.orderBy("status").collect():  # at most a row a code
        if row["status"] is not None:
            print(row["status"], row["count"], file=sys.stderr)


def lint(spark: SparkSession, a) -> None:
    from .operators.filtering import low_complexity_removed
    from .sources.fastq import OK, read_fastq
    from .sources.sinks import filtered_record

    kept = low_complexity_removed(read_fastq(spark, *a.paths).filter(F.col("status") == OK), max_proportion=a.max_proportion)
    kept.select(filtered_record(F.col("name"), F.col("comment"), F.col("seq"), F.col("qual")).alias("value")).write.text(a.output)


def _records(spark, a):
    from .sources import sam

    if a.path.endswith(".bam"):
        if a.refs:
            return sam.read_bam(spark, a.path), sam.sam_references(spark, a.refs)
        with sam.open_binary(a.path) as raw:
            _, refs = sam.bam_header(sam.Bgzf(raw))
        return sam.read_bam(spark, a.path), spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(refs)], "tid int, name string, length long")
    return sam.read_sam(spark, a.path), sam.sam_references(spark, a.path)


def alignments(spark: SparkSession, a) -> None:
    from .operators import regions
    from .operators.filtering import check_arguments
    from .operators.histogram import WIDTHS
    from .plans.reports import alignments_report
    from .sources import sinks

    check_arguments(tag_name=a.tag_name, tag_value=a.tag_value, haplotype=a.haplotype)
    records, refs = _records(spark, a)
    own = None
    if a.region:
        own = regions.clipped(spark.range(1).select(regions.region_struct(F.lit(a.region)).alias("r")).select("r.*"), refs)
    tag = (a.tag_name, a.tag_value) if a.tag_name else None
    rep = alignments_report(records, refs, unmapped=a.unmapped and own is None, recalculate_quality=a.recalc_qual, read_group=a.read_group, haplotype=a.haplotype, tag=tag, poly_a_reverse=a.poly_a_rev, regions=own)
    places = {"coverage": 4, "ref_coverage": 4, "mean_quality": 2, "iden": 2, "acc": 2}
    for name, df, after, p in (("rows", rep.rows, "runid", places), ("flagstats", rep.flagstats, "ref", None), ("runids", rep.run_ids, "runid", None), ("basecallers", rep.basecallers, "basecaller", None), ("polya", rep.poly_a, "lower", None)):
        sinks.write_table(df, f"{a.output}/{name}", sample=a.sample, after=after, places=p)
    sinks.write_histograms(rep.histograms, f"{a.output}/histograms", {"length": 0, **WIDTHS})
    if rep.unmapped_histograms is not None:
        sinks.write_histograms(rep.unmapped_histograms, f"{a.output}/histograms_unmapped", {"length": 0, "quality": WIDTHS["quality"]})
    if a.bed or a.segments:
        _coverage(rep.records, refs, a, f"{a.output}/coverage", by_strand=True)


def _coverage(records, refs, a, path: str, *, by_strand: bool) -> None:
    from .operators.coverage import THRESHOLDS
    from .plans.coverage_report import coverage_report
    from .sources import sinks

    for c in coverage_report(records, refs, beds=dict(b.split("=", 1) for b in a.bed), segments=a.segments, thresholds=a.thresholds or THRESHOLDS, by_strand=by_strand):
        sinks.write_table(c.summary, f"{path}/{c.name}/summary", places={"mean": 2})
        sinks.write_table(c.distribution, f"{path}/{c.name}/distribution", places={"frac": 3})
        c.tracks.select("track", F.concat_ws("\t", "chrom", "start", "end", "depth").alias("value")).write.partitionBy("track").option("compression", "gzip").text(f"{path}/{c.name}/tracks")


def index(spark: SparkSession, a) -> None:
    from .sources import chunk_index, sam

    if a.mode == "build":
        print(chunk_index.build_index(a.bam, a.index, every=a.chunk_size))
    elif a.mode == "dump":
        print(chunk_index.dump(a.index))
    else:
        with sam.open_binary(a.bam) as raw:
            header, _ = sam.bam_header(sam.Bgzf(raw))
        sam.write_bam(sam.read_bam(spark, a.bam, index=a.index, chunk=a.chunk), a.output, header=header)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("seqlake").getOrCreate()
    if a.command == "coverage":
        records, refs = _records(spark, a)
        _coverage(records, refs, a, a.output, by_strand=False)
    else:
        {"reads": reads, "lint": lint, "alignments": alignments, "index": index}[a.command](spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
