"""Alignment rows, flag counts and run ids of alignment records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alignment import DUPLICATE, NOT_PRIMARY, QCFAIL, SECONDARY, SUPPLEMENTARY, UNMAPPED, alignment_stats, cigar_totals, direction, has, implausible, is_good, query_end, query_start
from ..functions.numeric import held, percent32
from ..functions.readgroup import parse_read_group

ROW = ("name", "runid", "ref", "coverage", "ref_coverage", "qstart", "qend", "rstart", "rend", "aligned_ref_len", "direction", "length", "read_length", "mean_quality", "start_time", "match", "ins", "del", "sub", "iden", "acc", "duplex")
FLAGSTATS = ("total", "primary", "secondary", "supplementary", "unmapped", "qcfail", "duplicate", "duplex", "duplex_forming")


def with_run(df: DataFrame, rg: str = "rg", rd: str = "rd") -> DataFrame:
    """runid and basecaller: from the read group if there is one, parsable or not; else the run id tag."""
    df = df.withColumn("_g", parse_read_group(F.col(rg)))
    there = F.col(rg).isNotNull()
    return df.withColumns({"runid": F.coalesce(F.when(there, F.col("_g.runid")).otherwise(F.col(rd)), F.lit("")), "basecaller": F.coalesce(F.col("_g.basecaller"), F.lit(""))}).drop("_g")


def placed(df: DataFrame, refs: DataFrame) -> DataFrame:
    """Good alignments with ref_length, their totals and clips; each CIGAR is read once."""
    out = df.filter(is_good(F.col("flag"))).join(refs.select(F.col("name").alias("ref"), F.col("length").alias("ref_length")), "ref")
    out = held(out, _c=cigar_totals(F.col("cigar")), qstart=query_start(F.col("cigar")), qend=query_end(F.col("cigar"), F.col("read_length")))
    return out.withColumns({**alignment_stats(F.col("_c"), F.col("nm")), "aligned_ref_len": F.col("_c.span")})


def fault() -> Column:
    """Why a placed alignment is refused, or null: no NM, identity or accuracy below 0, or more edits than columns."""
    wrong = implausible({k: F.col(k) for k in ("iden", "acc", "length")}, F.col("nm"))
    return F.when(F.col("nm").isNull(), "no NM tag").when(F.coalesce(wrong, F.lit(False)), "implausible alignment information")


def refused(df: DataFrame, refs: DataFrame) -> DataFrame:
    """(name, reason) of the good alignments that alignment_rows leaves out."""
    return placed(df, refs).select("name", fault().alias("reason")).filter(F.col("reason").isNotNull())


def alignment_rows(df: DataFrame, refs: DataFrame, *, strict: bool = False) -> DataFrame:
    """The table of good alignments. df: name, runid, ref, flag, pos, cigar, nm, read_length, mean_quality, start_time, dx.

    Alignments with a fault() are left out (refused() has them), or raise if strict.
    """
    out = placed(df, refs)
    if strict:
        stop = F.when(fault().isNotNull(), F.raise_error(F.concat_ws(": ", fault(), F.col("name"))).cast("long")).otherwise(F.col("nm"))
        out = held(out, nm=stop).filter(F.col("nm").isNotNull())
    else:
        out = out.filter(fault().isNull())
    out = out.withColumns({
        "coverage": percent32(F.col("qend") - F.col("qstart"), F.col("read_length")),
        "ref_coverage": percent32(F.col("aligned_ref_len"), F.col("ref_length")),
        "rstart": F.col("pos"), "rend": F.col("pos") + F.col("aligned_ref_len"),
        "direction": direction(F.col("flag")), "duplex": F.coalesce(F.col("dx"), F.lit(0)).cast("int"),
    })
    return out.select(*ROW)


def unmapped_rows(df: DataFrame) -> DataFrame:
    """The same table's shape for unmapped reads: no coordinates, zero counts."""
    none = {c: F.lit(None).cast("double") for c in ("coverage", "ref_coverage", "qstart", "qend", "rstart", "rend", "iden", "acc")}
    zero = {c: F.lit(0).cast("long") for c in ("aligned_ref_len", "length", "match", "ins", "del", "sub")}
    rows = df.filter(has(F.col("flag"), UNMAPPED))
    return rows.withColumns({**none, **zero, "ref": F.lit("*"), "direction": F.lit("*"), "duplex": F.coalesce(F.col("dx"), F.lit(0)).cast("int")}).select(*ROW)


def flagstats(df: DataFrame, refs: DataFrame | None = None, *, unmapped: bool = False) -> DataFrame:
    """Counts of flags by reference: all references if `refs` (name) is given, and "*" for unmapped reads if asked."""
    flag, dx = F.col("flag"), F.coalesce(F.col("dx"), F.lit(0))
    lost = has(flag, UNMAPPED)
    test = {
        "total": F.lit(True), "primary": ~has(flag, NOT_PRIMARY), "secondary": has(flag, SECONDARY), "supplementary": has(flag, SUPPLEMENTARY), "unmapped": lost,
        "qcfail": has(flag, QCFAIL), "duplicate": has(flag, DUPLICATE), "duplex": dx == 1, "duplex_forming": dx == -1,
    }
    rows = (df if unmapped else df.filter(~lost)).withColumn("ref", F.when(lost, "*").otherwise(F.col("ref")))
    out = rows.groupBy("ref").agg(*(F.sum(t.cast("long")).alias(n) for n, t in test.items()))
    if refs is None:
        return out
    names = refs.select(F.col("name").alias("ref"))
    names = names.unionByName(names.sparkSession.range(1).select(F.lit("*").alias("ref"))) if unmapped else names
    return names.join(out, "ref", "left").na.fill(0, list(FLAGSTATS))
