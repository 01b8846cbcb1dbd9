"""Regions: text and table forms, clipping, tiling, overlap joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 1 << 14


def parse_bed(lines: DataFrame, line: str = "value") -> DataFrame:
    """(chr, start, end) of well-formed lines: three columns or more, whole numbers, 0 <= start < end."""
    p = F.split(F.regexp_replace(F.col(line), r"[\r\n]+$", ""), "\t")
    whole = lambda c: F.when(c.rlike(r"^\s*[+-]?\d+$"), F.trim(c).try_cast("long"))
    out = lines.select(F.get(p, F.lit(0)).alias("chr"), whole(F.get(p, F.lit(1))).alias("start"), whole(F.get(p, F.lit(2))).alias("end"))
    return out.filter((F.col("chr") != "") & (F.col("start") >= 0) & (F.col("start") < F.col("end")))


def region_struct(text: Column) -> Column:
    """chr, chr:start or chr:start-end (from 1, inclusive, commas allowed) as struct<chr,start,end>; half-open from 0."""
    pattern = r"^(.*?)(?::([\d,]+)(?:-([\d,]*))?)?$"
    number = lambda g: F.regexp_replace(F.regexp_extract(text, pattern, g), ",", "").try_cast("long")
    return F.struct(F.regexp_extract(text, pattern, 1).alias("chr"), F.greatest(F.coalesce(number(2) - 1, F.lit(0)), F.lit(0)).alias("start"), F.coalesce(number(3), F.lit(2**31 - 1).cast("long")).alias("end"))


def region_text(chr_: Column, start: Column, end: Column) -> Column:
    return F.concat(chr_, F.lit(":"), (start + 1).cast("string"), F.lit("-"), end.cast("string"))


def clipped(regions: DataFrame, refs: DataFrame) -> DataFrame:
    """Regions on known references, cut to their length, empty ones dropped; with tid for the header's order."""
    known = regions.join(refs.select(F.col("name").alias("chr"), "tid", F.col("length").alias("_length")), "chr")
    cut = known.withColumn("start", F.least("start", "_length")).withColumn("end", F.least("end", "_length"))
    return cut.filter(F.col("start") < F.col("end")).drop("_length")


def ordered(regions: DataFrame) -> DataFrame:
    return regions.orderBy("tid", "start", "end")


def whole_genome(refs: DataFrame) -> DataFrame:
    return refs.select("tid", F.col("name").alias("chr"), F.lit(0).cast("long").alias("start"), F.col("length").alias("end"))


def segments(refs: DataFrame, length: int) -> DataFrame:
    """Tiles of a fixed length; the last of each reference is cut."""
    tiles = refs.filter("length > 0").select("tid", F.col("name").alias("chr"), "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(length).cast("long"))).alias("start"))
    return tiles.select("tid", "chr", "start", F.least(F.col("start") + length, "length").alias("end"))


def overlap_join(left: DataFrame, right: DataFrame, *, key: str, width: int = BIN, how: str = "inner") -> DataFrame:
    """Pairs of left (key, start, end) and right (key, r_start, r_end) that overlap; each once.

    Both sides are dealt to bins of `width`, so it is an equi-join on key and bin that any size of either
    side can shuffle; a pair that shares several bins is taken in the first. how="left" keeps lonely left rows.
    """
    bins = lambda a, b: F.sequence(F.floor(F.col(a) / width), F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / width))
    a = left.withColumn("_bin", F.explode(bins("start", "end")))
    b = right.withColumn("_bin", F.explode(bins("r_start", "r_end")))
    first = F.col("_bin") == F.greatest(F.floor(F.col("start") / width), F.floor(F.col("r_start") / width))
    met = a.join(b, [key, "_bin"]).filter((F.col("start") < F.col("r_end")) & (F.col("end") > F.col("r_start")) & first).drop("_bin")
    if how != "left":
        return met
    keys = [c for c in left.columns]
    lonely = left.join(met.select(*keys).distinct(), keys, "left_anti")
    return met.unionByName(lonely, allowMissingColumns=True)
