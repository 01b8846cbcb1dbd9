"""Read-group strings: <runid>_<model>[_<modified-base model>][_<barcode>][-hex]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN_ID_LENGTHS = (36, 40)  # of a UUID and of a SHA-1
TYPE = "struct<runid:string,basecaller:string,modcaller:string,barcode:string>"


def strip_hex_suffix(text: Column) -> Column:
    """Without a last `-` and up to eight hexadecimal digits."""
    return F.regexp_replace(text, r"-[0-9A-Fa-f]{0,8}$", "")


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.when(text.rlike(pattern), F.nullif(F.regexp_extract(text, pattern, group), F.lit("")))


def parse_read_group(text: Column) -> Column:
    """A struct of runid, basecaller, modcaller, barcode; null where absent. Null in, null fields out."""
    s = strip_hex_suffix(text)
    run = F.regexp_extract(s, r"^([^_]*)", 1)
    whole = ~F.contains(s, F.lit("_"))
    good = ~whole & F.length(run).isin(*RUN_ID_LENGTHS)
    model = F.when(good, F.substring(s, F.length(run) + 2, F.length(s)))
    two = r"(?s)^([^@]*@[^_@]*)_(.*@[^_]*)(?:_(.*))?$"  # more than one @: the core model, then the other
    one = r"(?s)^(.*@[^_]*)(?:_(.*))?$"
    double = model.rlike(two)
    return F.struct(
        F.when(whole | good, run).alias("runid"),
        F.when(double, F.regexp_extract(model, two, 1)).otherwise(_group(model, one, 1)).alias("basecaller"),
        F.when(double, F.regexp_extract(model, two, 2)).alias("modcaller"),
        F.when(double, _group(model, two, 3)).otherwise(_group(model, one, 2)).alias("barcode"),
    )
