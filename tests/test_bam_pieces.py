"""One BAM file that is written and indexed in pieces."""

import pytest
from pyspark.sql import functions as F

from seqlake.plans import file_queries
from seqlake.sources import chunk_index, sam


@pytest.fixture(scope="module")
def one(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('bam')}/one.bam"
    ids = spark.range(40_000).repartitionByRange(5, "id").sortWithinPartitions("id")
    reads = ids.select(F.format_string("r%05d", "id").alias("name"), F.repeat(F.lit("ACGTN"), (F.col("id") % 30 + 1).cast("int")).alias("seq"), F.repeat(F.lit("I5!IA"), (F.col("id") % 30 + 1).cast("int")).alias("qual"), F.concat(F.lit("rn:i:"), F.col("id").cast("string")).alias("tags"))
    return path, sam.write_one_bam(sam.unaligned(reads), path, header="@HD\tVN:1.6\n")


def test_pieces_make_one_file(spark, one):
    path, starts = one
    assert len(starts) == 5 and starts[0] == 0 and starts == sorted(set(starts))
    with open(path, "rb") as f:
        raw = sam.Bgzf(f)
        sam.bam_header(raw)
        names = [b[32 : 31 + b[8]].decode() for _, b in sam.raw_records(raw)]
    assert names == [f"r{i:05d}" for i in range(40_000)]
    rows = sam.read_bam(spark, path, columns="qname string, seq string, tags map<string,struct<type:string,value:string>>").orderBy("qname").collect()
    assert len(rows) == 40_000 and all(r.qname == f"r{i:05d}" and r.seq == "ACGTN" * (i % 30 + 1) and r.tags["rn"].value == str(i) for i, r in enumerate(rows))


def test_index_by_pieces_is_the_index(spark, one, tmp_path):
    path, starts = one
    for every in (1, 7, 500):
        here, there = str(tmp_path / f"a{every}"), str(tmp_path / f"b{every}")
        assert chunk_index.build_index(path, here, every=every) == chunk_index.build_index_by_pieces(spark, path, there, starts, every=every)
        assert open(here, "rb").read() == open(there, "rb").read()
    # Chunks of one are read in runs, not 40,000 tasks.
    got = sam.read_bam(spark, path, index=str(tmp_path / "a1"), columns="qname string")
    assert got.rdd.getNumPartitions() < 2 * sam.SPLITS and got.distinct().count() == 40_000


def test_chunk_index_query_has_no_single_task(spark, small, monkeypatch):
    written = []
    monkeypatch.setattr(sam, "write_one_bam", lambda df, path, *, header, f=sam.write_one_bam: written.append(df) or f(df, path, header=header))
    file_queries.bam_chunk_index(spark, small).count()
    assert "rangepartitioning" in written[0]._jdf.queryExecution().executedPlan().toString()
