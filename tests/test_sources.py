import gzip
import struct

import pytest
from pyspark.sql import functions as F

from seqlake.plans.reports import alignments_report, reads_report
from seqlake.sources import chunk_index, sam, sinks
from seqlake.sources.fastq import read_fastq, records
from seqlake.streaming import summaries

GOOD = "@r1 runid=a ch=3\nACGT\n+\nIIII\n@r2\nAC\nGT\n+r2\nII\n@I\n"


def status(text):
    return [(r[0], r[2], r[3], r[4]) for r in records(iter(text.splitlines()))]


def test_fastq_framing():
    assert status(GOOD) == [("r1", "ACGT", "IIII", "R_RECORD_OK"), ("r2", "ACGT", "II@I", "R_RECORD_OK")]
    assert status("@r1\nACGT\n+\nII\n")[0][3] == "F_QUAL_TRUNCATED"
    assert [x[3] for x in status("@r1\nACGT\n@r2\nA\n+\nI\n")] == ["F_QUAL_MISSING", "R_RECORD_OK"]
    assert status("\n\n") == []


def test_fastq_files(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(GOOD)
    (tmp_path / "sub").mkdir()
    with gzip.open(tmp_path / "sub" / "b.fq.gz", "wt") as f:
        f.write("@r3\tRD:Z:run\trn:i:5\nAAAAAAAAAAAAAAAAA\n+\nAAAAAAAAAAAAAAAAA\n@r4\nACG\n+\nI")
    (tmp_path / "x.fastq.bak").write_text("no")
    (tmp_path / "c.fastq.gz").write_bytes(gzip.compress(GOOD.encode() * 50)[:60])
    assert {r.file_path.rsplit("/", 1)[1] for r in read_fastq(spark, str(tmp_path)).collect()} == {"a.fastq", "c.fastq.gz"}
    rep = reads_report(spark, str(tmp_path), recursive=True)
    files = {r.filename.rsplit("/", 1)[1]: r for r in rep.per_file.collect()}
    assert (files["a.fastq"].n_seqs, files["a.fastq"].n_bases, files["a.fastq"].f_file_ok) == (2, 8, 1)
    assert (files["b.fq.gz"].n_seqs, files["b.fq.gz"].f_qual_truncated, files["b.fq.gz"].f_stream_error) == (1, 1, 1)
    assert files["c.fastq.gz"].f_stream_error == 1
    reads = {r.read_id: r for r in rep.per_read.collect()}
    assert (reads["r3"].runid, reads["r3"].read_number, reads["r3"].read_length, reads["r3"].mean_quality) == ("run", 5, 17, 32.0)
    assert (reads["r1"].runid, reads["r1"].channel) == ("a", 3)
    with pytest.raises(Exception, match="bad input"):
        reads_report(spark, str(tmp_path / "sub"), strict=True).per_file.collect()


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(f"r{i}", "runid=a" if i % 2 else None, "ACGT", "IIII", i % 3) for i in range(20)], "name string, comment string, seq string, qual string, ibarcode int")
    sinks.write_demultiplexed(df, str(tmp_path / "plex"), reads_per_file=4)
    names = sorted(p.name for p in (tmp_path / "plex").iterdir() if p.is_dir())
    assert names == ["barcode=barcode0001", "barcode=barcode0002", "barcode=unclassified"]
    with pytest.raises(Exception, match="exist"):
        sinks.write_demultiplexed(df, str(tmp_path / "plex"))
    sinks.write_fastq(df.coalesce(1), str(tmp_path / "plain"), gzip=False)
    text = "".join(p.read_text() for p in (tmp_path / "plain").glob("part-*"))
    assert "@r0\nACGT\n+\nIIII\n" in text and "@r1 runid=a\n" in text
    sinks.write_table(df.select("name", F.lit(0.125).alias("q")).coalesce(1), str(tmp_path / "t"), sample="s", after="name", places={"q": 2})
    assert "name\tsample_name\tq\nr0\ts\t0.12\n" in "".join(p.read_text() for p in (tmp_path / "t").glob("part-*"))


def test_tag_strings(spark):
    df = spark.createDataFrame([("RG:Z:a:b\tNM:i:3\tXX:B:c\tbad",)], "t string")
    assert [tuple(x) for x in df.select(sinks.aux_tags(F.col("t")).alias("a")).first()["a"]] == [("RG", "Z", "a:b"), ("NM", "i", "3")]
    with pytest.raises(Exception, match="bad tag"):
        df.select(sinks.aux_tags(F.col("t"), strict=True).alias("a")).collect()


SAM = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chrX\tLN:156040895\n" + "\t".join(
    ["read", "16", "chrX", "43690", "60", "9S480M36S", "*", "0", "0", "A" * 525, "5" * 525, "NM:i:0", "qs:i:12", "st:Z:2022-08-18T20:18:39Z", "RG:Z:2807d2374ca5985b978a023fba4f92836a5ce559_dna_r10.4.1_e8.2_sup@v3.5.1"]
)


def test_sam_report(spark, tmp_path):
    path = str(tmp_path / "t.sam")
    (tmp_path / "t.sam").write_text(SAM + "\n")
    assert sam.sort_order(spark, path) == "coordinate"
    refs = sam.sam_references(spark, path)
    rep = alignments_report(sam.read_sam(spark, path), refs, unmapped=True)
    r = rep.rows.first()
    assert (r.runid, r.qstart, r.qend, r.rstart, r.rend, r.aligned_ref_len, r.direction, r.length, r.read_length) == ("2807d2374ca5985b978a023fba4f92836a5ce559", 9, 489, 43689, 44169, 480, "-", 480, 525)
    assert (round(r.coverage, 4), round(r.ref_coverage, 4), round(r.mean_quality, 2), r.iden, r.acc, r.duplex, r.start_time) == (91.4286, 0.0003, 20.0, 100.0, 100.0, 0, "2022-08-18T20:18:39Z")
    assert rep.basecallers.first().basecaller == "dna_r10.4.1_e8.2_sup@v3.5.1"
    assert {(x.track, x.start, x.end, x.depth) for x in rep.depth.collect()} == {("total", 43689, 44169, 1), ("rev", 43689, 44169, 1)}
    bad = SAM.replace("9S480M36S", "1S").replace("NM:i:0", "NM:i:10")
    (tmp_path / "bad.sam").write_text(bad + "\n")
    with pytest.raises(Exception, match="implausible|raise"):
        alignments_report(sam.read_sam(spark, str(tmp_path / "bad.sam")), refs, strict=True).rows.collect()


def test_bam_round_trip_and_chunks(spark, tmp_path):
    n = 3000
    reads = spark.range(n).coalesce(1).select(F.format_string("r%05d", "id").alias("name"), F.repeat(F.lit("ACGTN"), (F.col("id") % 30 + 1).cast("int")).alias("seq"), F.repeat(F.lit("I5!IA"), (F.col("id") % 30 + 1).cast("int")).alias("qual"), F.concat(F.lit("rn:i:"), F.col("id").cast("string"), F.lit("\tRG:Z:g")).alias("tags"))
    sam.write_bam(sam.unaligned(reads), str(tmp_path / "out"))
    path = str(tmp_path / "out" / "part-00000.bam")
    back = sam.read_bam(spark, path)
    rows = back.orderBy("qname").collect()
    assert len(rows) == n and rows[7].seq == "ACGTN" * 8 and rows[7].qual[:5] == [40, 20, 0, 40, 32] and rows[7].tags["rn"].value == "7"
    assert {r.flag for r in rows} == {4} and rows[0].ref == "*"
    index = str(tmp_path / "x.fci")
    assert chunk_index.build_index(path, index, every=100) == 30
    size, recs = chunk_index.read_index(index)
    assert size == 100 and [q for _, q in recs][:2] == ["r00000", "r00100"]
    assert [r.qname for r in sam.read_bam(spark, path, index=index, chunk=29).orderBy("qname").collect()] == [f"r{i:05d}" for i in range(2900, 3000)]
    assert sam.read_bam(spark, path, index=index).count() == n
    assert sam.read_bam(spark, path, index=index, chunk=77).count() == 0
    assert chunk_index.index_frame(spark, index).count() == 30 and chunk_index.dump(index).startswith("Index contains 30 chunks of size 100.")
    (tmp_path / "bad").write_bytes(b"nothing" + struct.pack("<Q", 1))
    with pytest.raises(ValueError):
        chunk_index.read_index(str(tmp_path / "bad"))


def test_stream_equals_batch(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{small}/events.parquet").repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = summaries.run_available(summaries.stream_counts(stream, "event_type"), "counted", str(tmp_path / "c"))
    want = spark.read.parquet(f"{small}/events.parquet").groupBy("event_type").count()
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_programs(spark, tmp_path):
    from seqlake.__main__ import main

    (tmp_path / "a.fastq").write_text(GOOD)
    out = tmp_path / "out"
    main(["reads", str(tmp_path / "a.fastq"), "--file", f"{out}/file", "--read", f"{out}/read", "--sample", "s", "--histograms", f"{out}/hist", "--bam", f"{out}/bam", "--demultiplex", f"{out}/plex", "--output", f"{out}/fastq"])
    text = "".join(p.read_text() for p in (out / "file").glob("part-*"))
    assert text.startswith("filename\tsample_name\tn_seqs") and "\ts\t2\t8\t4\t4\t" in text
    bam = str(next((out / "bam").glob("*.bam")))
    main(["index", "build", bam, f"{out}/i", "--chunk_size", "1"])
    main(["index", "fetch", bam, f"{out}/i", f"{out}/one", "--chunk", "1"])
    assert sum(sam.read_bam(spark, str(p)).count() for p in (out / "one").glob("*.bam")) == 1
    (tmp_path / "t.sam").write_text(SAM.replace("LN:156040895", "LN:50000") + "\n")
    (tmp_path / "r.bed").write_text("chrX\t43680\t43700\nchrX\t0\t10\n")
    main(["alignments", str(tmp_path / "t.sam"), "--output", f"{out}/al", "--unmapped", "--bed", f"own={tmp_path}/r.bed", "--region", "chrX:43000-44000"])
    assert "read\t" in "".join(p.read_text() for p in (out / "al" / "rows").glob("part-*"))
    summary = "".join(p.read_text() for p in (out / "al" / "coverage" / "own" / "summary").glob("part-*"))
    assert "chrX\t43680\t43700\t20\t11\t0.55\t0\t1" in summary and "own\t0\t30\t30\t11\t0.37\t0\t1" in summary
    main(["coverage", str(tmp_path / "t.sam"), "--output", f"{out}/cov", "--segments", "30000"])
    main(["lint", str(tmp_path / "a.fastq"), "--output", f"{out}/lint"])
    assert "@r1 runid=a" in "".join(p.read_text() for p in (out / "lint").glob("part-*"))
