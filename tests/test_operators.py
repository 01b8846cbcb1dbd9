import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqlake.operators import alignments, chunks, coverage, filtering, histogram, regions, summary

REFS = "tid int, name string, length long"


def test_outcome_order_and_bounds(spark):
    rows = [(100, 9.0), (99, 9.0), (200, 9.0), (201, 1.0), (150, 8.9), (150, float("nan"))]
    df = spark.createDataFrame(rows, "length long, quality float")
    got = [r.status for r in filtering.with_outcome(df, min_length=100, max_length=200, min_quality=9.0).collect()]
    assert got == ["R_RECORD_OK", "R_TOO_SHORT", "R_RECORD_OK", "R_TOO_LONG", "R_LOW_QUALITY", "R_RECORD_OK"]


def test_dust_filter(spark):
    df = spark.createDataFrame([("A" * 50, 50, 20.0), ("ACGTTGCAAGCTTACGGATC", 20, 20.0), ("", 0, 20.0)], "seq string, length long, quality float")
    assert [r.status for r in filtering.with_outcome(df, seq="seq", max_dust=0.5).collect()] == ["R_DUST_MASKED", "R_RECORD_OK", "R_RECORD_OK"]
    assert filtering.low_complexity_removed(df).count() == 2


def test_per_file_counts(spark):
    rows = [("a", 10, 10.0, "R_RECORD_OK"), ("a", 30, 20.0, "R_RECORD_OK"), ("a", 5, 9.0, "R_TOO_SHORT"), ("b", 5, 9.0, "R_TOO_SHORT"), ("b", 5, 9.0, "F_QUAL_MISSING")]
    df = spark.createDataFrame(rows, "filename string, length long, quality float, status string")
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "filename string")
    got = {r.filename: r for r in summary.per_file(df, files=files).collect()}
    assert (got["a"].n_seqs, got["a"].n_bases, got["a"].min_length, got["a"].max_length, got["a"].mean_quality, got["a"].r_record_ok) == (2, 40, 10, 30, 15.0, 3)
    assert (got["b"].n_seqs, got["b"].min_length, got["b"].mean_quality, got["b"].f_qual_missing, got["b"].r_record_ok) == (0, 0, 0.0, 1, 1)
    assert got["c"].n_seqs == 0 and got["c"].r_too_short == 0


def test_length_histogram_edges(spark):
    df = spark.createDataFrame([(0,), (5,), (5,), (10_000_000,), (99_999_999,), (None,)], "n long")
    assert {tuple(r) for r in histogram.lengths(df, "n").collect()} == {(0, 1, 1), (5, 6, 2), (10_000_000, 0, 2)}


def intervals(n, seed):
    random.seed(seed)
    out = []
    for _ in range(n):
        a = random.randrange(300)
        out.append((random.choice("xy"), random.choice("+-"), a, a + random.choice((0, 1, 7, 60))))
    return out


@pytest.mark.parametrize("block", [16, 1 << 20])
def test_depth_by_base(spark, block):
    rows = intervals(120, 3)
    df = spark.createDataFrame(rows, "chrom string, strand string, start long, end long")
    got = Counter()
    for r in coverage.depth(df, strand="strand", block=block).collect():
        for p in range(r.start, r.end):
            assert (r.chrom, r.track, p) not in got
            got[r.chrom, r.track, p] = r.depth
    want = Counter()
    for c, s, a, b in rows:
        for p in range(a, b):
            want[c, "total", p] += 1
            want[c, "fwd" if s == "+" else "rev", p] += 1
    assert {k: v for k, v in got.items() if v} == dict(want)


def test_region_summary_by_base(spark):
    rows = intervals(80, 5)
    df = spark.createDataFrame(rows, "chrom string, strand string, start long, end long")
    regs = [("x", 0, 50), ("x", 40, 400), ("y", 100, 101), ("z", 0, 10), ("y", 500, 600)]
    reg = spark.createDataFrame(regs, "chrom string, r_start long, r_end long")
    cut = coverage.in_regions(coverage.depth(df).drop("track"), reg)
    got = {(r.chrom, r.start, r.end): r for r in coverage.summary_with_total(cut, reg, "all", thresholds=(1, 3)).collect()}
    depth = Counter()
    for c, _, a, b in rows:
        for p in range(a, b):
            depth[c, p] += 1
    every = []
    for c, a, b in regs:
        d = [depth[c, p] for p in range(a, b)]
        every += d
        r = got[c, a, b]
        assert (r.length, r.bases, r.min, r.max, r["3x"]) == (b - a, sum(d), min(d), max(d), round(sum(x >= 3 for x in d) / len(d), 3))
    r = got["all", 0, len(every)]
    assert (r.bases, r.min, r.max) == (sum(every), min(every), max(every))
    dist = {r.depth: r.frac for r in coverage.depth_distribution(cut).collect()}
    assert dist[max(every)] == round(sum(x >= max(every) for x in every) / len(every), 3) and dist[0] == 1.0


def test_cigar_stretches(spark):
    df = spark.createDataFrame([("x", "+", 10, "2S5M3D4M1I2=")], "chrom string, strand string, start long, cigar string")
    assert sorted((r.start, r.end) for r in coverage.cigar_stretches(df).collect()) == [(10, 15), (18, 22), (22, 24)]


@pytest.mark.parametrize("width", [8, 1 << 14])
def test_overlap_join(spark, width):
    a = [(i, c, s, e) for i, (c, _, s, e) in enumerate(intervals(60, 1))]
    b = [(i, c, s, e) for i, (c, _, s, e) in enumerate(intervals(40, 2)) if e > s]
    left = spark.createDataFrame(a, "i int, k string, start long, end long")
    right = spark.createDataFrame(b, "j int, k string, r_start long, r_end long")
    got = Counter((r.i, r.j) for r in regions.overlap_join(left, right, key="k", width=width).collect())
    assert got == Counter((i, j) for i, c, s, e in a for j, d, u, v in b if c == d and s < v and e > u)
    assert {r.i for r in regions.overlap_join(left, right, key="k", width=width, how="left").collect()} == {x[0] for x in a}


def test_regions(spark):
    lines = spark.createDataFrame([("a\t1\t5\tx",), ("a\t5\t5",), ("a\t-1\t5",), ("a\tq\t5",), ("a\t1",), ("b\t0\t99\r",)], "value string")
    bed = regions.parse_bed(lines)
    assert {tuple(r) for r in bed.collect()} == {("a", 1, 5), ("b", 0, 99)}
    refs = spark.createDataFrame([(0, "b", 10), (1, "a", 3)], REFS)
    assert {(r.chr, r.start, r.end) for r in regions.clipped(bed, refs).collect()} == {("a", 1, 3), ("b", 0, 10)}
    assert [(r.start, r.end) for r in regions.segments(refs, 4).orderBy("tid", "start").collect()] == [(0, 4), (4, 8), (8, 10), (0, 3)]
    text = spark.createDataFrame([("chr1:1,001-2,000",), ("chr1",), ("chr1:5",)], "t string").select(regions.region_struct(F.col("t")).alias("r")).select("r.*")
    assert [tuple(r) for r in text.collect()] == [("chr1", 1000, 2000), ("chr1", 0, 2**31 - 1), ("chr1", 4, 2**31 - 1)]


def test_chunks_partition_rows(spark):
    df = spark.range(0, 1000, 7).withColumnRenamed("id", "at").withColumn("q", F.concat(F.lit("q"), F.col("at").cast("string")))
    index = chunks.chunk_index(df, "at", "q", every=10).orderBy("chunk_id").collect()
    assert [r.qname for r in index] == [f"q{70 * k}" for k in range(15)]
    assert [r.at for r in chunks.chunk(df, "at", 14, every=10).orderBy("at").collect()] == [980, 987, 994]
    assert chunks.chunk(df, "at", 99, every=10).count() == 0
    n = chunks.numbered(df, "at").orderBy("at").collect()
    assert [r.ordinal for r in n] == list(range(len(n)))


def test_flagstats_and_rows(spark):
    rows = [("r1", "x", 0, 0, "10M", 0), ("r2", "x", 256, 0, "10M", 0), ("r3", "x", 1024, 5, "10M", 1), ("r4", "*", 4, -1, "*", -1), ("r5", "x", 0, 3, "1S", 10)]
    df = spark.createDataFrame(rows, "name string, ref string, flag int, pos long, cigar string, dx int")
    df = df.withColumns({"nm": F.when(F.col("name") == "r5", 10).otherwise(0).cast("long"), "read_length": F.lit(10).cast("long"), "mean_quality": F.lit(9.0), "runid": F.lit(""), "start_time": F.lit("")})
    refs = spark.createDataFrame([(0, "x", 100), (1, "y", 50)], REFS)
    got = {r.ref: r for r in alignments.flagstats(df, refs, unmapped=True).collect()}
    assert (got["x"].total, got["x"].primary, got["x"].secondary, got["x"].duplicate, got["x"].duplex) == (4, 3, 1, 1, 1)
    assert got["y"].total == 0 and (got["*"].total, got["*"].unmapped, got["*"].duplex_forming) == (1, 1, 1)
    assert "*" not in {r.ref for r in alignments.flagstats(df, refs).collect()}
    good = alignments.alignment_rows(df, refs).collect()
    assert [r.name for r in good] == ["r1"] and good[0].ref_coverage == 10.0
    assert alignments.unmapped_rows(df).first().direction == "*"
    with pytest.raises(Exception, match="implausible"):
        alignments.alignment_rows(df.withColumn("nm", F.when(F.col("name") == "r1", 99).otherwise(0).cast("long")), refs, strict=True).collect()


def test_arguments():
    for bad in ({"max_dust": 2}, {"window": 0}, {"tag_name": "HP"}, {"tag_name": "ABC", "tag_value": 1}, {"bed_files": ("a",)}, {"counts": (-1,)}, {"haplotype": 1, "tag_name": "HP", "tag_value": 1}):
        with pytest.raises(ValueError):
            filtering.check_arguments(**bad)
    filtering.check_arguments(tag_name="HP", tag_value=1)
