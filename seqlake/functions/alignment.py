"""CIGAR strings, SAM flags and tags."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import percent32

# SAM flag bits.
UNMAPPED, REVERSE, SECONDARY, QCFAIL, DUPLICATE, SUPPLEMENTARY = 4, 16, 256, 512, 1024, 2048
NOT_PRIMARY = SECONDARY | SUPPLEMENTARY | UNMAPPED
NOT_GOOD = NOT_PRIMARY | QCFAIL | DUPLICATE
NOT_COVERED = UNMAPPED | SECONDARY | QCFAIL | DUPLICATE


def has(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) != 0


def is_good(flag: Column) -> Column:
    """Primary, mapped, not failed, no duplicate."""
    return ~has(flag, NOT_GOOD)


def op_total(cigar: Column, ops: str) -> Column:
    """Summed lengths of some operations."""
    found = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{ops}]"), F.lit(1))
    return F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def query_start(cigar: Column) -> Column:
    """Leading soft clip, after any hard clip."""
    return F.coalesce(F.regexp_extract(cigar, r"^(?:\d+H)*(\d+)S", 1).try_cast("long"), F.lit(0).cast("long"))


def query_end(cigar: Column, length: Column) -> Column:
    """Query length without the trailing soft clip."""
    return length.cast("long") - F.coalesce(F.regexp_extract(cigar, r"^.*\D(\d+)S(?:\d+H)*$", 1).try_cast("long"), F.lit(0).cast("long"))


def cigar_totals(cigar: Column) -> Column:
    """struct<match, ins, del, span> of a CIGAR: matched, inserted and deleted bases, and those of the reference, in one pass."""
    found = F.regexp_extract_all(cigar, F.lit(r"\d+[MIDNX=]"), F.lit(0))
    names = ("match", "ins", "del", "span")
    zero = F.struct(*(F.lit(0).cast("long").alias(n) for n in names))

    def step(a, x):
        n, op = F.substring(x, F.lit(1), F.length(x) - 1).cast("long"), F.right(x, F.lit(1))
        kinds = {"match": ("M", "=", "X"), "ins": ("I",), "del": ("D",), "span": ("M", "=", "X", "D", "N")}
        return F.struct(*((a[k] + F.when(op.isin(*ops), n).otherwise(0)).alias(k) for k, ops in kinds.items()))

    return F.aggregate(found, zero, step)


def alignment_stats(totals: Column, nm: Column) -> dict[str, Column]:
    """match, ins, del, sub (substitutions), length, iden, acc from cigar_totals(). iden and acc are percent, null where undefined."""
    match, ins, dele = totals["match"], totals["ins"], totals["del"]
    sub = nm.cast("long") - ins - dele
    length = match + ins + dele
    return {"match": match, "ins": ins, "del": dele, "sub": sub, "length": length, "iden": percent32(match - sub, match), "acc": (F.lit(100.0) - percent32(nm, length).cast("double")).cast("float")}


def implausible(stats: dict[str, Column], nm: Column) -> Column:
    return (stats["iden"] < 0) | (stats["acc"] < 0) | (nm > stats["length"])


def tag_any_case(tags: Column, name: str) -> Column:
    """A tag by its upper-case, else its lower-case name."""
    return F.coalesce(tags[name.upper()], tags[name.lower()])


def direction(flag: Column) -> Column:
    return F.when(has(flag, REVERSE), "-").otherwise("+")


def query_to_reference(cigar: Column, start: Column) -> Column:
    """array<long>: the reference position of every query base, -1 where it has none."""
    ops = F.arrays_zip(
        F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1)), lambda x: x.cast("int")).alias("n"),
        F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2)).alias("op"),
    )
    zero = F.struct(start.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def step(a, x):
        both, ref = x["op"].isin("M", "=", "X"), x["op"].isin("M", "=", "X", "D", "N")
        new = F.when(both & (x["n"] > 0), F.sequence(a["at"], a["at"] + x["n"] - 1)).when(x["op"].isin("I", "S"), F.array_repeat(F.lit(-1).cast("long"), x["n"])).otherwise(F.array().cast("array<bigint>"))
        return F.struct((a["at"] + F.when(ref, x["n"]).otherwise(0)).alias("at"), F.concat(a["out"], new).alias("out"))

    return F.aggregate(ops, zero, step, lambda a: a["out"])


def cigar_ops(cigars):
    """(row, length, operation) of all operations of an Arrow array of CIGARs in turn; operations are bytes."""
    import numpy as np

    cigars = cigars.cast(pa.large_string()).fill_null("")
    if not len(cigars) or cigars.buffers()[2] is None:
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "u1")
    ends = np.frombuffer(cigars.buffers()[1], "i8")[cigars.offset : cigars.offset + len(cigars) + 1]
    text = np.frombuffer(cigars.buffers()[2], "u1")[ends[0] : ends[-1]]
    ends = ends - ends[0]
    at = np.flatnonzero((text < 48) | (text > 57))
    row = np.searchsorted(ends, at, "right") - 1
    first = np.maximum(np.concatenate([[0], at[:-1] + 1]), ends[row]) if len(at) else at  # of the digits before it
    good = np.flatnonzero((at > first) & np.isin(text[at], np.frombuffer(b"MIDNSHP=X", "u1")))
    at, row, first = at[good], row[good], first[good]
    length = np.zeros(len(at), "i8")
    for k in range(int((at - first).max(initial=0))):
        on = first + k < at
        length[on] = length[on] * 10 + (text[(first + k)[on]] - 48)
    return row, length, text[at]


def before(row, length):
    """Of operations in turn, the sum of the lengths before each in its row."""
    import numpy as np

    upto = np.cumsum(length) - length
    new = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    return upto - upto[np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))]


def consumes(op, ops: bytes):
    import numpy as np

    return np.isin(op, np.frombuffer(ops, "u1"))


def placed_totals(cigar: Column, start: Column) -> Column:
    """struct<bases, aligned, weighted> of query_to_reference(): its length, its elements from 0 on, and the sum of these, each times its
    place from 1. By operation, so no base is spelt out."""

    @F.arrow_udf("struct<bases:long,aligned:long,weighted:long>")
    def run(cigars: pa.Array, starts: pa.Array) -> pa.Array:
        import numpy as np

        row, n, op = cigar_ops(cigars)
        query = np.where(consumes(op, b"MIS=X"), n, 0)
        q, r = before(row, query), before(row, np.where(consumes(op, b"MDN=X"), n, 0)) + starts.fill_null(0).to_numpy(zero_copy_only=False).astype("i8")[row]
        cut = np.clip(-r, 0, n)  # bases that lie before 0
        a, b, n = r + cut, q + cut + 1, np.where(consumes(op, b"M=X"), n - cut, 0)
        sums = np.zeros((3, len(cigars)), "i8")
        for out, x in zip(sums, (query, n, n * a * b + (a + b) * (n * (n - 1) // 2) + (n - 1) * n * (2 * n - 1) // 6), strict=True):
            np.add.at(out, row, x)
        null = cigars.is_null().to_numpy(zero_copy_only=False) | starts.is_null().to_numpy(zero_copy_only=False)
        return pa.StructArray.from_arrays([pa.array(x, mask=null) for x in sums], ["bases", "aligned", "weighted"])

    return run(cigar, start.cast("long"))
