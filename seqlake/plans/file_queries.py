"""Sources, sinks and whole reports as queries: ordinary tables are written in a file format, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import alignment as A
from ..operators import alignments, coverage, filtering, histogram, summary
from ..sources import chunk_index, fastq, sam, sinks
from ..sources.files import found, scratch
from . import queries as Q
from .coverage_report import stretches
from .queries import ALN_SQL, GOOD_SQL, PCT, REFS_SQL, aln, query, refs, t


def _folder(spark, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


# --- reads -----------------------------------------------------------------------------------------

SEQ_SQL = "repeat('ACGTN', CAST(o_custkey % 9 + 1 AS INTEGER))"
QUAL_SQL = "repeat('I', CAST(5 * (o_custkey % 9 + 1) AS INTEGER))"


def order_reads(spark, d):
    n = (F.col("o_custkey") % 9 + 1).cast("int")
    return t(spark, d, "orders").select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("name"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("note="), F.col("o_orderstatus"))).alias("comment"),
        F.repeat(F.lit("ACGTN"), n).alias("seq"), F.repeat(F.lit("I"), n * 5).alias("qual"), (F.col("o_custkey") % 7).alias("ibarcode"),
    )


@query(f"SELECT 'r' || o_orderkey AS name, CASE WHEN o_orderkey % 3 <> 0 THEN 'note=' || o_orderstatus ELSE '' END AS comment, {SEQ_SQL} AS seq, {QUAL_SQL} AS qual, 'R_RECORD_OK' AS status FROM orders")
def fastq_round_trip(spark, d):
    path = _folder(spark, "fastq")
    sinks.write_fastq(order_reads(spark, d).repartition(4), path, gzip=False)
    got = fastq.read_fastq(spark, *found([path], (".txt",))).filter(F.col("status") == filtering.KEPT)
    return got.select("name", F.coalesce("comment", F.lit("")).alias("comment"), "seq", "qual", "status")


@query(f"SELECT CASE WHEN o_custkey % 7 = 0 THEN 'unclassified' ELSE 'barcode' || lpad(CAST(o_custkey % 7 AS VARCHAR), 4, '0') END AS barcode, count(*) AS n_reads, CAST(sum(length({SEQ_SQL})) AS BIGINT) AS n_bases FROM orders GROUP BY 1")
def demultiplexed_files(spark, d):
    path = _folder(spark, "demultiplexed")
    sinks.write_demultiplexed(order_reads(spark, d), path, reads_per_file=1000)
    got = spark.read.text(path).filter(~F.col("value").rlike("^[@+I]"))  # the sequence lines
    return got.groupBy("barcode").agg(F.count("*").alias("n_reads"), F.sum(F.length("value")).alias("n_bases"))


@query("SELECT 'r' || o_orderkey AS name, 'RG' AS tag, 'Z' AS type, 'g' || (o_custkey % 3) AS value FROM orders UNION ALL SELECT 'r' || o_orderkey, 'ch', 'i', CAST(o_custkey % 512 AS VARCHAR) FROM orders")
def aux_tags(spark, d):
    c = F.col("o_custkey")
    tags = F.concat(F.lit("RG:Z:g"), (c % 3).cast("string"), F.lit("\tch:i:"), (c % 512).cast("string"), F.lit("\tBAD:i:1\txx:Q:2"))
    return t(spark, d, "orders").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("name"), F.explode(sinks.aux_tags(tags)).alias("x")).select("name", "x.*")


@query(f"SELECT 'r' || o_orderkey AS qname, 4 AS flag, {SEQ_SQL} AS seq, CAST(5 * (o_custkey % 9 + 1) AS INTEGER) AS n_qual, 'g' || (o_custkey % 7) AS rg FROM orders")
def unaligned_bam(spark, d):
    path = _folder(spark, "unaligned")
    rows = order_reads(spark, d).withColumn("tags", F.concat(F.lit("RG:Z:g"), F.col("ibarcode").cast("string")))
    sam.write_bam(sam.unaligned(rows), path)
    got = sam.read_bam(spark, path)
    return got.select("qname", "flag", "seq", F.size("qual").alias("n_qual"), F.col("tags")["RG"]["value"].alias("rg"))


# --- alignments --------------------------------------------------------------------------------------


def placed(spark, d, rows=None):
    """aln() with the columns of an alignment file."""
    return aln(spark, d, rows).select(
        F.col("name").alias("qname"), "flag", "ref", "pos", (F.col("l_linenumber") * 10).cast("int").alias("mapq"), "cigar", F.lit("*").alias("rnext"), F.lit(-1).cast("long").alias("pnext"), F.lit(0).cast("long").alias("tlen"),
        F.lit("ACGT").alias("seq"), F.array(*(F.lit(30),) * 4).alias("qual"), F.create_map(F.lit("NM"), F.struct(F.lit("i").alias("type"), F.col("nm").cast("string").alias("value"))).alias("tags"), "l_orderkey", "l_linenumber",
    )


def _records(df):
    """Rows for sam.write_bam."""
    return df.drop("l_orderkey", "l_linenumber").select(F.lit("").alias("file_path"), F.lit(0).cast("long").alias("voffset"), "*")


CIGAR_SQL = "a || 'S' || (m - m // 2) || 'M' || CASE WHEN i > 0 THEN i || 'I' ELSE '' END || (m // 2) || 'M' || CASE WHEN de > 0 THEN de || 'D' ELSE '' END || CASE WHEN b > 0 THEN b || 'S' ELSE '' END"
HEADER = "@HD\tVN:1.6\tSO:unsorted\n@SQ\tSN:A\tLN:3000\n@SQ\tSN:N\tLN:2800\n@SQ\tSN:R\tLN:2600\n"


@query(f"WITH {ALN_SQL} SELECT name AS qname, flag, ref, pos, CAST(a * 10 AS INTEGER) AS mapq, {CIGAR_SQL} AS cigar, CAST(nm AS VARCHAR) AS nm, 'ACGT' AS seq, 120 AS qual_sum FROM aln")
def bam_round_trip(spark, d):
    path = _folder(spark, "bam")
    sam.write_bam(_records(placed(spark, d)), path, header=HEADER)
    columns = "qname string, flag int, ref string, pos long, mapq int, cigar string, seq string, qual array<int>, tags map<string,struct<type:string,value:string>>"
    return _read_columns(sam.read_bam(spark, path, columns=columns))


@query(Q.SQL["bam_round_trip"])
def sam_round_trip(spark, d):
    path = _folder(spark, "sam")
    s = lambda c: F.col(c).cast("string")
    line = F.concat_ws("\t", "qname", s("flag"), "ref", (F.col("pos") + 1).cast("string"), s("mapq"), "cigar", "rnext", (F.col("pnext") + 1).cast("string"), s("tlen"), "seq", F.lit("????"), F.concat(F.lit("NM:i:"), F.col("tags")["NM"]["value"]))
    placed(spark, d).select(line.alias("value")).write.text(path)
    return _read_columns(sam.read_sam(spark, path))


def _read_columns(df):
    return df.select("qname", "flag", "ref", "pos", "mapq", "cigar", F.col("tags")["NM"]["value"].alias("nm"), "seq", F.aggregate("qual", F.lit(0), lambda a, x: a + x).alias("qual_sum"))


@query("SELECT CAST(rn // 500 AS BIGINT) AS chunk_id, name AS qname, CAST(least(500, n - rn) AS BIGINT) AS n_records FROM (SELECT l_orderkey || '.' || l_linenumber AS name, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS rn, count(*) OVER () AS n FROM lineitem) WHERE rn % 500 = 0")
def bam_chunk_index(spark, d):
    """A BAM file in one piece, its index written and read, and every chunk read through the index."""
    path, index = f"{_folder(spark, 'bam')}.bam", _folder(spark, "index")
    rows = Q.aln_columns(t(spark, d, "lineitem")).repartitionByRange("l_orderkey", "l_linenumber").sortWithinPartitions("l_orderkey", "l_linenumber")
    starts = sam.write_one_bam(_records(placed(spark, d, rows)), path, header=HEADER)
    chunk_index.build_index_by_pieces(spark, path, index, starts, every=500)
    _, heads = chunk_index.read_index(index)
    at = [at for at, _ in heads]

    def counted(batches):
        """Records by chunk: that whose head is the last at or before the record."""
        import numpy as np
        import pyarrow as pa

        for b in batches:
            chunk, n = np.unique(np.searchsorted(at, b.column(0).to_numpy(), "right") - 1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(n, pa.int64())], ["chunk_id", "n"])

    got = sam.read_bam(spark, path, index=index, columns="voffset long").mapInArrow(counted, "chunk_id long, n long").groupBy("chunk_id").agg(F.sum("n").alias("n_records"))
    named = spark.createDataFrame([(k, name) for k, (_, name) in enumerate(heads)], "chunk_id long, qname string")
    return got.join(named, "chunk_id").select("chunk_id", "qname", "n_records")


@query(f"""WITH {ALN_SQL}, {REFS_SQL}, x AS (SELECT aln.name, m, i, de, CASE WHEN a % 3 = 1 THEN nm + 400 WHEN a % 3 = 2 THEN nm END AS nm FROM aln JOIN refs ON ref = refs.name WHERE {GOOD_SQL})
SELECT name, CASE WHEN nm IS NULL THEN 'no NM tag' ELSE 'implausible alignment information' END AS reason FROM x WHERE nm IS NULL OR nm > m + i + de OR nm - i - de > m""")
def nm_reject(spark, d):
    turn = F.col("l_linenumber") % 3
    return alignments.refused(aln(spark, d).withColumn("nm", F.when(turn == 1, F.col("nm") + 400).when(turn == 2, F.col("nm"))), refs(spark))


@query(f"WITH {ALN_SQL}, iv AS (SELECT ref AS chrom, pos AS s, pos + m + de AS e FROM aln WHERE (flag & 1796) = 0 AND hp = 2), {Q.depth_sql('true')} SELECT chrom, s AS start, e AS \"end\", depth FROM runs")
def depth_by_tag(spark, d):
    own = stretches(filtering.by_haplotype(aln(spark, d), 2))
    return coverage.depth(own, block=256).select("chrom", "start", "end", "depth")


@query(f"WITH {ALN_SQL}, iv AS (SELECT ref AS chrom, pos AS s, pos + m AS e FROM aln WHERE (flag & 1796) = 0), {Q.depth_sql('true')} SELECT chrom, s AS start, e AS \"end\", depth FROM runs")
def depth_by_cigar(spark, d):
    return coverage.depth(stretches(aln(spark, d), by_cigar=True), block=256).select("chrom", "start", "end", "depth")


def _bins(what: str, value: str, width: float, source: str) -> str:
    return f"SELECT '{what}' AS metric, CAST(floor(least(CAST({value} AS FLOAT), CAST(100 AS FLOAT)) / CAST({width} AS FLOAT)) AS INTEGER) AS bin, count(*) AS count FROM {source} GROUP BY ALL"


@query(f"WITH {ALN_SQL}, u AS (SELECT *, a + m + i + b AS n FROM aln WHERE (flag & 4) <> 0) SELECT 'length' AS metric, CAST(n AS INTEGER) AS bin, count(*) AS count FROM u GROUP BY ALL UNION ALL {_bins('quality', 'q', 0.02, 'u')}")
def unmapped_hist(spark, d):
    from .reports import unmapped_histograms

    return unmapped_histograms(aln(spark, d))


GOOD_ROWS_SQL = f"g AS (SELECT *, {PCT('m + i', '(a + m + i + b)')} AS coverage, {Q.ACC} AS acc FROM aln JOIN refs ON ref = refs.name WHERE {GOOD_SQL} AND nm <= m + i + de AND m >= nm - i - de)"


@query(f"WITH {ALN_SQL}, {REFS_SQL}, {GOOD_ROWS_SQL} {_bins('accuracy', 'acc', 0.0001, 'g')} UNION ALL {_bins('coverage', 'coverage', 0.01, 'g')}")
def alignment_histograms(spark, d):
    rows = alignments.alignment_rows(aln(spark, d), refs(spark))
    return histogram.metric_set(rows, {"accuracy": ("acc", histogram.WIDTHS["accuracy"]), "coverage": ("coverage", histogram.WIDTHS["coverage"])})


@query("""SELECT lang, 'length' AS metric, CAST(n_chars AS VARCHAR) || chr(9) || CAST(n_chars + 1 AS VARCHAR) || chr(9) || CAST(count(*) AS VARCHAR) AS value FROM documents WHERE lang IS NOT NULL GROUP BY lang, n_chars
UNION ALL SELECT lang, 'quality', printf('%.2f', bin * 0.02) || chr(9) || printf('%.2f', (bin + 1) * 0.02) || chr(9) || CAST(n AS VARCHAR) FROM (SELECT lang, CAST(floor(CAST(doc_id % 50 AS FLOAT) / CAST(0.02 AS FLOAT)) AS INTEGER) AS bin, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL)""")
def histogram_files(spark, d):
    path = _folder(spark, "histograms")
    rows = t(spark, d, "documents").filter(F.col("lang").isNotNull()).select("lang", F.col("n_chars").alias("n"), (F.col("doc_id") % 50).alias("q"))
    widths = {"length": 0, "quality": histogram.WIDTHS["quality"]}
    sinks.write_histograms(histogram.metric_set(rows, {"length": ("n", 0), "quality": ("q", widths["quality"])}, "lang"), path, widths)
    return spark.read.text(path).select("lang", "metric", "value")


@query(f"WITH {ALN_SQL} SELECT CASE WHEN rg IS NOT NULL THEN rg ELSE 'run' || (l_orderkey % 4) END AS runid, '' AS basecaller, count(*) AS count FROM aln GROUP BY ALL")
def alignment_run_ids(spark, d):
    df = aln(spark, d).withColumn("rd", F.concat(F.lit("run"), (F.col("l_orderkey") % 4).cast("string")))
    return summary.counts_by(alignments.with_run(df), "runid", "basecaller")


@query(f"WITH {ALN_SQL} SELECT name FROM aln WHERE a * 10 >= 30 AND pos >= 100 AND pos < 900")
def mapq_start_filter(spark, d):
    df = aln(spark, d).withColumn("mapq", F.col("l_linenumber") * 10)
    return filtering.mapped_well(df, min_mapq=30, starts_in=(100, 900)).select("name")


@query(f"WITH {ALN_SQL} SELECT name FROM aln WHERE ref = 'N' AND pos < 700 AND pos + greatest(m + de, 1) > 500")
def region_scan(spark, d):
    return sam.in_region(aln(spark, d), "N", 500, 700).select("name")


@query(f"WITH {ALN_SQL} SELECT CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS direction, dx AS duplex, count(*) AS n FROM aln GROUP BY ALL".replace("flag & 16 <>", "(flag & 16) <>"))
def directions(spark, d):
    return aln(spark, d).groupBy(A.direction(F.col("flag")).alias("direction"), F.col("dx").alias("duplex")).agg(F.count("*").alias("n"))
