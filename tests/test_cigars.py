"""CIGARs taken a batch at a time, against one at a time."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from seqlake.functions import alignment as A
from seqlake.operators import coverage


def some_cigars():
    random.seed(11)
    return ["", "*", None, "5", "M", "12", "3M4", "10M", "0M5M", "3Q4M", "2M3", "7M"] + ["".join(f"{random.choice([0, 1, 7, 12, 345])}{random.choice('MIDNSHP=X')}" for _ in range(random.randrange(1, 9))) for _ in range(300)]


def test_operations():
    cigars = some_cigars()
    for array in (pa.array(cigars), pa.array(["9M", *cigars, "8M"]).slice(1, len(cigars))):
        got = [(r, n, chr(o)) for r, n, o in zip(*(x.tolist() for x in A.cigar_ops(array)), strict=True)]
        assert got == [(i, int(n), o) for i, c in enumerate(cigars) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", c or "")]
    assert not len(A.cigar_ops(pa.array([], pa.string()))[0])


def test_totals_are_those_of_the_map(spark):
    rows = [(i, c, random.choice([-400, -3, 0, 50])) for i, c in enumerate(some_cigars()) if c is not None]
    got = spark.createDataFrame(rows, "i int, c string, at long").select("i", A.placed_totals(F.col("c"), F.col("at")).alias("t"), A.query_to_reference(F.col("c"), F.col("at")).alias("m")).collect()
    for r in got:
        on = [(k, x) for k, x in enumerate(r.m, 1) if x >= 0]
        assert tuple(r.t) == (len(r.m), len(on), sum(k * x for k, x in on))


def test_stretches(spark):
    rows = [(f"c{i}", c, "+", i) for i, c in enumerate(some_cigars())]
    got = coverage.cigar_stretches(spark.createDataFrame(rows, "chrom string, cigar string, strand string, start long"))
    want = []
    for name, c, strand, at in rows:
        for n, o in re.findall(r"(\d+)([MIDNSHP=X])", c or ""):
            if o in "M=X" and int(n):
                want.append((name, strand, at, at + int(n)))
            at += int(n) if o in "MDN=X" else 0
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "regexp" not in plan  # before, each operation's row parsed the whole CIGAR again
