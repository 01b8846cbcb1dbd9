"""Comments of read records: `key=value` words, or SAM tags between tabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import held, leading_int
from .readgroup import parse_read_group

# Spellings of each known key, and the tag that it is written as ("" goes to the rest).
KEYS = {
    "runid": (("runid", "RD"), "RD:Z"),
    "rg": (("RG",), "RG:Z"),
    "basecaller": (("basecall_model_version_id", "model_version_id"), ""),
    "flow_cell_id": (("flow_cell_id", "FC"), "FC:Z"),
    "barcode": (("barcode", "BC"), "BC:Z"),
    "barcode_alias": (("barcode_alias", "BA"), "BA:Z"),
    "read_number": (("read", "RN", "rn"), "rn:i"),
    "channel": (("ch", "CH"), "ch:i"),
    "start_time": (("start_time", "ST", "st"), "st:Z"),
}
NUMBERS = ("read_number", "channel")
SAM_WORD, PLAIN_WORD = r"(?s)^:*([^:]*)(?::+([^:]+))?(?::(.*))?$", r"(?s)^=*([^=]*)(?:=(.*))?$"

APART = "\x01"


def is_sam_comment(comment: Column) -> Column:
    """SAM tags if a read group or run id tag starts the comment or follows a tab."""
    starts = F.startswith(comment, F.lit("RG:Z:")) | F.startswith(comment, F.lit("RD:Z:"))
    return F.coalesce(starts | F.contains(comment, F.lit("\tRG:Z:")) | F.contains(comment, F.lit("\tRD:Z:")), F.lit(False))


def comment_words(comment: Column, sam: Column) -> Column:
    """array<struct<key,type,value,word>>; value is null for a word without a delimiter."""
    parts = F.filter(F.split(F.coalesce(comment, F.lit("")), F.when(sam, F.lit("\t")).otherwise(F.lit(" "))), lambda w: w != "")

    # One replacement a word sets its parts apart by a sign that no comment holds.
    cut = F.transform(parts, lambda w: F.struct(w.alias("word"), F.split(F.when(sam, F.regexp_replace(w, SAM_WORD, f"$1{APART}$2{APART}$3")).otherwise(F.regexp_replace(w, PLAIN_WORD, f"$1{APART}{APART}$2")), APART, 3).alias("p")))
    part = lambda x, k: F.get(x["p"], F.lit(k))
    return F.transform(cut, lambda x: F.struct(
        part(x, 0).alias("key"),
        F.when(sam, part(x, 1)).alias("type"),
        F.when(F.when(sam, part(x, 1) != "").otherwise(F.contains(x["word"], F.lit("="))), part(x, 2)).alias("value"),
        x["word"],
    ))


def last_values(words: Column) -> Column:
    """struct of the last value of each known field; null where there is none. One fold over the words."""
    zero = F.struct(*(F.lit(None).cast("string").alias(n) for n in KEYS))
    step = lambda a, w: F.struct(*(F.when(w["key"].isin(*keys) & w["value"].isNotNull(), w["value"]).otherwise(a[n]).alias(n) for n, (keys, _) in KEYS.items()))
    return F.aggregate(words, zero, step)


def barcode_number(barcode: Column) -> Column:
    """barcode01 is 1; unclassified and other names are 0."""
    return leading_int(F.substring(barcode, 8, 1_000_000))


def with_read_meta(df: DataFrame, comment: str = "comment") -> DataFrame:
    """df with the fields of each comment: strings default to "", numbers to 0; also tags and rest as text."""
    df = df.withColumn("_sam", is_sam_comment(F.col(comment)))
    df = held(df, _words=comment_words(F.col(comment), F.col("_sam")))
    df = held(df, _last=last_values(F.col("_words")))
    own = {name: F.coalesce(F.col("_last")[name], F.lit("")) for name in KEYS}
    df = df.withColumns({n: leading_int(v) if n in NUMBERS else v for n, v in own.items()}).drop("_last")
    df = held(df.withColumn("ibarcode", barcode_number(F.col("barcode"))), _group=F.when(F.col("rg") != "", parse_read_group(F.col("rg"))))

    def tag(w):
        out = F.when(w["value"].isNull(), F.lit(None).cast("string"))
        for keys, name in KEYS.values():
            out = out.when(w["key"].isin(*keys), F.concat(F.lit(f"{name}:"), w["value"]) if name else F.lit(None))
        return out.when(F.col("_sam"), F.concat_ws(":", w["key"], w["type"], w["value"]))

    known = [k for keys, name in KEYS.values() if name for k in keys]
    model = KEYS["basecaller"][0]
    text = lambda w: F.when(w["value"].isNull(), w["key"]).otherwise(F.concat_ws("=", w["key"], w["value"]))
    left = F.filter("_words", lambda w: w["value"].isNull() | w["key"].isin(*model) | (~F.col("_sam") & ~w["key"].isin(*known)))
    df = df.withColumn("rest", F.translate(F.array_join(F.transform(left, text), " "), "\t", " "))
    need_run, need_caller = F.col("runid") == "", F.col("basecaller") == ""
    from_group = F.when(need_run & (F.col("rg") != ""), F.col("_group.runid"))
    comment_tag = F.when((F.col("rest") != "") & ~F.startswith("rest", F.lit(" ")), F.concat(F.lit("CO:Z:"), F.col("rest")))
    tags = F.array_compact(F.concat(F.transform("_words", tag), F.array(comment_tag, F.concat(F.lit("RD:Z:"), from_group))))
    df = df.withColumn("tags", F.array_join(tags, "\t"))
    return df.withColumns({
        "runid": F.coalesce(from_group, "runid"),
        "basecaller": F.coalesce(F.when(need_caller & (F.col("rg") != ""), F.col("_group.basecaller")), "basecaller"),
    }).drop("_sam", "_words", "_group")
