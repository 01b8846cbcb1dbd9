"""Outcome codes of read records and the filters of both report programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alignment import NOT_COVERED, has, is_good, tag_any_case
from ..functions.dust import THRESHOLD, WINDOW, dust_fraction

# Outcome codes in the order in which reports list them.
CODES = ("F_FILE_OK", "F_STREAM_ERROR", "F_QUAL_MISSING", "F_QUAL_TRUNCATED", "F_UNKNOWN_ERROR", "R_RECORD_OK", "R_TOO_LONG", "R_TOO_SHORT", "R_LOW_QUALITY", "R_DUST_MASKED")
KEPT = "R_RECORD_OK"


def outcome(length: Column, quality: Column, *, min_length: int = 0, max_length: int = 2**31 - 1, min_quality: float = 0.0, dust: Column | None = None, max_dust: float = 1.0) -> Column:
    """The first test that a record fails, or R_RECORD_OK; all bounds are inclusive, NaN quality passes."""
    out = F.when(length > max_length, "R_TOO_LONG").when(length < min_length, "R_TOO_SHORT").when((quality < min_quality) & ~F.isnan(quality), "R_LOW_QUALITY")
    if dust is not None:
        out = out.when(dust > max_dust, "R_DUST_MASKED")
    return out.otherwise(KEPT)


def with_outcome(df: DataFrame, *, length: str = "length", quality: str = "quality", seq: str | None = None, max_dust: float | None = None, window: int = WINDOW, threshold: int = THRESHOLD, **bounds) -> DataFrame:
    """df with `status`. Masking, the dear test, sees only records that pass the others."""
    df = df.withColumn("status", outcome(F.col(length), F.col(quality), **bounds))
    if max_dust is None or seq is None:
        return df
    df = df.withColumn("_dust", dust_fraction(F.when(F.col("status") == KEPT, F.col(seq)), window, threshold))
    return df.withColumn("status", F.when(F.col("_dust") > max_dust, "R_DUST_MASKED").otherwise(F.col("status"))).drop("_dust")


def kept(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == KEPT).drop("status")


def low_complexity_removed(df: DataFrame, seq: str = "seq", *, max_proportion: float = 0.95, window: int = WINDOW, threshold: int = THRESHOLD) -> DataFrame:
    """Reads of which at most max_proportion is masked; empty reads stay."""
    return df.filter(F.coalesce(dust_fraction(F.col(seq), window, threshold) <= max_proportion, F.lit(True)))


def by_tag(df: DataFrame, tags: str, name: str, value: int) -> DataFrame:
    """Records whose integer tag (either case) has a value; missing or other tags drop out."""
    return df.filter(tag_any_case(F.col(tags), name).try_cast("long") == value)


def by_haplotype(df: DataFrame, value: int, tags: str = "tags") -> DataFrame:
    return by_tag(df, tags, "HP", value)


def by_read_group(df: DataFrame, group: str, column: str = "rg") -> DataFrame:
    return df.filter(F.col(column) == group)


def good_alignments(df: DataFrame, flag: str = "flag") -> DataFrame:
    return df.filter(is_good(F.col(flag)))


def covering(df: DataFrame, flag: str = "flag", *, exclude: int = NOT_COVERED, include: int = 0) -> DataFrame:
    """Records that count for coverage: none of the excluded bits, and any of the included if given."""
    df = df.filter(~has(F.col(flag), exclude))
    return df.filter(has(F.col(flag), include)) if include else df


def mapped_well(df: DataFrame, *, min_mapq: int = 0, starts_in: tuple[int, int] | None = None, mapq: str = "mapq", pos: str = "pos") -> DataFrame:
    """Optional mapping-quality and start-position filters."""
    df = df.filter(F.col(mapq) >= min_mapq) if min_mapq else df
    return df.filter((F.col(pos) >= starts_in[0]) & (F.col(pos) < starts_in[1])) if starts_in else df


def poly_a(df: DataFrame, *, min_cover: float = 95.0, min_quality: float = 10.0, reverse: bool = False) -> DataFrame:
    """Alignments whose tail length (`pt`) counts: near-complete, of one strand, of quality, not split (`pi`)."""
    strand = has(F.col("flag"), 16)
    return df.filter((F.col("ref_cover") >= min_cover) & (strand if reverse else ~strand) & (F.col("mean_quality") >= min_quality) & F.col("pi").isNull() & (F.col("pt") >= 0))


def check_arguments(*, max_dust: float | None = None, window: int = WINDOW, threshold: int = THRESHOLD, tag_name: str | None = None, tag_value: int | None = None, haplotype: int | None = None, bed_files=(), bed_names=(), counts=()) -> None:
    """ValueError for options that the report programs refuse."""
    if max_dust is not None and not 0 <= max_dust <= 1:
        raise ValueError("max_dust must be in [0, 1]")
    if window <= 0 or threshold <= 0:
        raise ValueError("DUST window and threshold must be positive")
    if (tag_name is None) != (tag_value is None):
        raise ValueError("tag name and value go together")
    if tag_name is not None and len(tag_name) > 2:
        raise ValueError("a tag name has at most two characters")
    if haplotype is not None and tag_name is not None:
        raise ValueError("haplotype excludes tag name and value")
    if len(bed_files) != len(bed_names):
        raise ValueError("each region file needs a name")
    if any(n < 0 for n in counts):
        raise ValueError("counts must not be negative")
