import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.functions import alignment as A
from seqlake.functions import comments as C
from seqlake.functions import dust as D
from seqlake.functions import numeric as N
from seqlake.functions import phred as P
from seqlake.functions import readgroup as R

SHA, UUID = "ef1af1ab8967cb20ca30dbeca93fd66592bf4619", "c886531d-28f5-41f6-b948-948e8cb78e5e"
MODEL, MOD, BAR, TAIL = "basecall_model_name@v1.2.3", "5mCG_5hmCG@v1", "barcode01", "-1A2B3C4D"


def test_read_group_cross_product(spark):
    cases = []
    for run, mod, bar, tail in itertools.product((SHA, UUID), (MOD, None), (BAR, None), (TAIL, "")):
        text = "_".join(x for x in (run, MODEL, mod, bar) if x) + tail
        cases.append((text, run, MODEL, mod, bar))
    assert len(cases) == 16
    df = spark.createDataFrame([(c[0],) for c in cases], "rg string").select("rg", R.parse_read_group(F.col("rg")).alias("g")).select("rg", "g.*")
    assert {tuple(r) for r in df.collect()} == set(cases)


@pytest.mark.parametrize("text,want", [("plain", ("plain", None, None, None)), ("short_model@v1", (None,) * 4), (f"{SHA}_nomodel", (SHA, None, None, None)), (None, (None,) * 4), ("", ("", None, None, None))])
def test_read_group_edges(spark, text, want):
    assert tuple(spark.createDataFrame([(text,)], "rg string").select(R.parse_read_group(F.col("rg")).alias("g")).first()["g"]) == want


@pytest.mark.parametrize("text,want", [("a-1A2b", "a"), ("a-", "a"), ("a-123456789", "a-123456789"), ("a-xyz", "a-xyz"), ("a", "a")])
def test_hex_suffix(spark, text, want):
    assert spark.range(1).select(R.strip_hex_suffix(F.lit(text)).alias("x")).first()["x"] == want


def meta(spark, comment):
    return C.with_read_meta(spark.createDataFrame([(comment,)], "comment string")).first()


def test_comment_dialects(spark):
    r = meta(spark, "RD:Z:dummy_run_id\trn:i:1234")
    assert (r.runid, r.read_number, r.channel, r.tags) == ("dummy_run_id", 1234, 0, "RD:Z:dummy_run_id\trn:i:1234")
    r = meta(spark, "RD:Z:")
    assert (r.runid, r.tags) == ("", "RD:Z:")
    r = meta(spark, "runid=a  ch=12x barcode=barcode07 word note= runid=b model_version_id=m")
    assert (r.runid, r.channel, r.ibarcode, r.basecaller) == ("b", 12, 7, "m")
    assert r.rest == "word note= model_version_id=m"
    assert r.tags == "RD:Z:a\tch:i:12x\tBC:Z:barcode07\tRD:Z:b\tCO:Z:word note= model_version_id=m"
    r = meta(spark, f"RG:Z:{SHA}_{MODEL}\tqs:f:9.5\tno")
    assert (r.runid, r.basecaller, r.tags) == (SHA, MODEL, f"RG:Z:{SHA}_{MODEL}\tqs:f:9.5\tCO:Z:no\tRD:Z:{SHA}")
    r = meta(spark, f"RG:Z:{SHA}_{MODEL}\tRD:Z:own")
    assert r.runid == "own"
    for nothing in (None, "", "   "):
        assert (meta(spark, nothing).runid, meta(spark, nothing).tags) == ("", "")


def test_qualities(spark):
    rows = [("A" * 17,), ("",), (None,), ("!~I5",)]
    got = [r[0] for r in spark.createDataFrame(rows, "q string").select(P.mean_quality(F.col("q"))).collect()]
    assert got[0] == 32.0 and math.isnan(got[1]) and got[2] is None
    want = -10 * math.log10(np.mean([10 ** (-(ord(c) - 33) / 10) for c in "!~I5"]))
    assert got[3] == np.float32(want)
    arrays = spark.createDataFrame([([0, 93, 40, 20],), ([],), ([255, 1],)], "q array<int>").select(P.mean_quality_of(F.col("q"))).collect()
    assert arrays[0][0] == np.float32(want) and math.isnan(arrays[1][0]) and math.isnan(arrays[2][0])


@pytest.mark.parametrize("width", [0.02, 0.0001, 0.01])
def test_bins_are_single_precision(spark, width):
    random.seed(4)
    v = [random.random() * 100 for _ in range(3000)] + [0.0, 100.0, 250.0, float("nan"), *(k * width for k in range(500))]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "v double").select(N.bin_index(F.col("v"), width)).collect()]
    want = [int(np.float32(min(100.0, x) if x == x else 100.0) / np.float32(width)) for x in v]
    assert got == want


def test_numbers(spark):
    rows = [("12ab", 12), ("", 0), ("-3", -3), (None, 0), (" 7", 7), ("x1", 0)]
    got = [r[0] for r in spark.createDataFrame([(a,) for a, _ in rows], "a string").select(N.leading_int(F.col("a"))).collect()]
    assert got == [b for _, b in rows]
    assert [N.decimals(w) for w in (0.02, 0.0001, 0.01, 1)] == [2, 4, 2, 0]
    assert (N.c_format(0.125, 2), N.c_format(2.675, 2), N.c_format(None, 2)) == ("0.12", "2.67", "nan")


def test_cigar(spark):
    df = spark.createDataFrame([("9S480M36S", 525, 43690 - 1, 0), ("5H3S10M2I4D10M1S2H", 26, 100, 8), ("10M", 10, 0, 1), ("4S", 4, 7, 0)], "c string, n long, pos long, nm long")
    s = A.alignment_stats(A.cigar_totals(F.col("c")), F.col("nm"))
    rows = df.select(A.query_start(F.col("c")), A.query_end(F.col("c"), F.col("n")), A.op_total(F.col("c"), "MDN=X"), *(s[k] for k in ("match", "ins", "del", "sub", "length", "iden", "acc"))).collect()
    assert tuple(rows[0]) == (9, 489, 480, 480, 0, 0, 0, 480, 100.0, 100.0)
    assert tuple(rows[1])[:8] == (3, 25, 24, 20, 2, 4, 2, 26)
    assert tuple(rows[2])[:2] == (0, 10)
    assert rows[3][8] is None and rows[3][9] is None


def brute_dust(seq, window, threshold):
    """Every stretch of a window that no shorter stretch in it outscores."""
    score, n = {}, len(seq) - 2
    word = [seq[i : i + 3] for i in range(n)]
    for a in range(n):
        c, total = Counter(), 0
        for b in range(a, min(n, a + window - 2)):
            total += c[word[b]]
            c[word[b]] += 1
            score[a, b] = (total, b - a)
    mask = [False] * len(seq)
    for (a, b), (s, k) in score.items():
        if k and s * 10 > threshold * k and all(score[x, y][0] * k <= s * score[x, y][1] for x in range(a, b + 1) for y in range(x + 1, b + 1)):
            for i in range(a, b + 3):
                mask[i] = True
    out = []
    for i, m in enumerate(mask):
        if m and (i == 0 or not mask[i - 1]):
            out.append([i, i + 1])
        elif m:
            out[-1][1] = i + 1
    return [tuple(x) for x in out]


def test_dust_matches_definition():
    random.seed(8)
    for _ in range(120):
        s = "".join(random.choice(random.choice(("ACGT", "A", "AT", "ACG"))) for _ in range(random.choice((0, 3, 12, 40, 70))))
        for w, t in ((20, 20), (12, 10)):
            assert D.masked_intervals(s, w, t) == brute_dust(s, w, t), (s, w, t)


def test_dust_cases(spark):
    assert D.masked_intervals("A" * 100) == [(0, 100)]
    assert D.masked_intervals("") == [] and D.masked_fraction("") == 0.0
    assert D.masked_intervals("A" * 30 + "N" + "A" * 30) == [(0, 30), (31, 61)]
    rows = spark.createDataFrame([("A" * 20,), ("",), (None,)], "s string").select(D.dust_fraction(F.col("s")), F.size(D.dust_intervals(F.col("s")))).collect()
    assert rows[0][0] == 1.0 and rows[1][0] == 0.0
