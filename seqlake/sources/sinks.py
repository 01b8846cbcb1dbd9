"""Writers: FASTQ text, demultiplexed files, tables as tab-separated text, SAM text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import c_format, decimals


def fastq_record(name: Column, comment: Column, seq: Column, qual: Column, *, separator: str = " ") -> Column:
    """The four lines of a record, without a last line end; no separator where there is no comment."""
    tail = F.when(F.coalesce(comment, F.lit("")) != "", F.concat(F.lit(separator), comment)).otherwise("")
    return F.concat(F.lit("@"), name, tail, F.lit("\n"), seq, F.lit("\n+\n"), qual)


def filtered_record(name: Column, comment: Column, seq: Column, qual: Column) -> Column:
    """As above; a tab goes before a comment that holds one."""
    return F.when(F.contains(F.coalesce(comment, F.lit("")), F.lit("\t")), fastq_record(name, comment, seq, qual, separator="\t")).otherwise(fastq_record(name, comment, seq, qual))


def reheadered(df: DataFrame, tags: str = "tags") -> DataFrame:
    """One column `value`: records whose comment is the SAM tag string."""
    return df.select(fastq_record(F.col("name"), F.col(tags), F.col("seq"), F.col("qual"), separator="\t").alias("value"))


def barcode_folder(number: Column) -> Column:
    return F.when(number == 0, "unclassified").otherwise(F.concat(F.lit("barcode"), F.lpad(number.cast("string"), 4, "0")))


def write_fastq(df: DataFrame, path: str, *, comment: str = "comment", gzip: bool = True, mode: str = "errorifexists") -> None:
    df.select(fastq_record(F.col("name"), F.col(comment), F.col("seq"), F.col("qual")).alias("value")).write.mode(mode).option("compression", "gzip" if gzip else "none").text(path)


def write_demultiplexed(df: DataFrame, path: str, *, barcode: str = "ibarcode", comment: str = "comment", reads_per_file: int | None = None, mode: str = "errorifexists") -> None:
    """gzip FASTQ below barcode=<folder>; files roll over after reads_per_file records."""
    out = df.select(barcode_folder(F.col(barcode)).alias("barcode"), fastq_record(F.col("name"), F.col(comment), F.col("seq"), F.col("qual")).alias("value"))
    writer = out.write.mode(mode).partitionBy("barcode").option("compression", "gzip")
    (writer.option("maxRecordsPerFile", reads_per_file) if reads_per_file else writer).text(path)


def write_table(df: DataFrame, path: str, *, sample: str | None = None, after: str | None = None, places: dict[str, int] | None = None, mode: str = "errorifexists") -> None:
    """Tab-separated text with a header; sample_name goes in after a column; numbers print as C prints them."""
    if sample is not None:
        at = df.columns.index(after) + 1 if after else 0
        df = df.withColumn("sample_name", F.lit(sample)).select(*df.columns[:at], "sample_name", *df.columns[at:])
    for c, n in (places or {}).items():
        df = df.withColumn(c, printed(F.col(c), n))
    df.write.mode(mode).option("sep", "\t").option("header", True).option("nullValue", "nan").option("emptyValue", "").option("quote", "\u0000").csv(path)


def write_histograms(bins: DataFrame, path: str, metrics: dict[str, float], *, mode: str = "errorifexists") -> None:
    """Tab-separated lower, upper and count without a header, a folder for each metric (and column before it), in order of lower."""
    from ..operators.histogram import edges

    whole = lambda c, width: F.col(c).cast("long").cast("string") if not width else F.format_string(f"%.{decimals(width)}f", F.col(c))
    text = lambda c: F.coalesce(*(F.when(F.col("metric") == m, whole(c, w)) for m, w in metrics.items()))
    rows = edges(bins, metrics)
    by = rows.columns[:-3]
    rows.repartition(*by).sortWithinPartitions(*by, "lower").select(*by, F.concat_ws("\t", text("lower"), text("upper"), F.col("count").cast("string")).alias("value")).write.mode(mode).partitionBy(*by).text(path)


def printed(value: Column, places: int) -> Column:
    @F.pandas_udf("string")
    def text(v: pd.Series) -> pd.Series:
        return v.map(lambda x: c_format(x, places))

    return text(value.cast("double"))


# Type letters of SAM tags that are kept.
TAG_TYPES = "iIcCsSfZH"


def aux_tags(tags: Column, *, strict: bool = False) -> Column:
    """array<struct<tag,type,value>> of a tab-separated tag string; other types raise if strict, else drop out."""
    parts = F.transform(F.filter(F.split(F.coalesce(tags, F.lit("")), "\t"), lambda x: x != ""), lambda x: F.struct(
        F.regexp_extract(x, r"(?s)^([^:]*):([^:]*):(.*)$", 1).alias("tag"), F.regexp_extract(x, r"(?s)^([^:]*):([^:]*):(.*)$", 2).alias("type"), F.regexp_extract(x, r"(?s)^([^:]*):([^:]*):(.*)$", 3).alias("value")))
    good = lambda x: x["type"].isin(*TAG_TYPES) & (F.length(x["tag"]) == 2)
    if strict:
        return F.when(F.forall(parts, good), parts).otherwise(F.raise_error(F.concat(F.lit("bad tag in: "), tags)).cast("array<struct<tag:string,type:string,value:string>>"))
    return F.filter(parts, good)


def unaligned_sam(df: DataFrame, *, tags: str = "tags") -> DataFrame:
    """SAM lines of unaligned reads: flag 4, no place, tags as they are."""
    line = F.concat_ws("\t", F.col("name"), F.lit("4"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.lit("0"), F.lit("0"), F.when(F.col("seq") == "", "*").otherwise(F.col("seq")), F.when(F.col("qual") == "", "*").otherwise(F.col("qual")), F.nullif(F.col(tags), F.lit("")))
    return df.select(line.alias("value"))
