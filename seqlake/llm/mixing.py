"""Mixing documents to target weights with soft membership (1). DataFrame functions only.

A labelled table trains the classifier on a sample of at most about `train_rows` labelled documents. On
one half, hashed counts of words (with their case) and of words' last two characters give a multinomial
weight of every bucket for every domain; on the other half, a logistic regression over a text's mean
weights and length turns them into calibrated posteriors p, rounded to 1/1000. A document of n tokens
drawn at rate r brings r n p_k expected tokens to domain k. Projected gradient steps fit rates in
[low, high] so that the domains' totals T' meet the targets T in least squares: the gradient lies in the
space of documents, but depends on a document only through p, so documents are first summed up by p, each
step is one aggregate of that small table, and the rates are a fold of the steps' vectors over p. The
residual is whitened by M = sum(n p p'), which makes the step length 1 safe. A document is repeated
floor(r + u) times, u uniform by a hash of the row. Every text is read and scored once.

Targets that no rates within [low, high] can meet leave a residual: it is returned with the totals, and
warned of, or raised if `strict`. Null and empty texts have no tokens and change no total; they get rates
like any. Unlabelled tables give one domain. Labels that are null, or of unknown ids, are ignored; of an id
labelled twice the largest counts. Repeated rows get the same rate and number of copies. Weights of
domains that no label has are ignored.
"""

from __future__ import annotations

import math
import warnings
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

WEIGHTS = {"0": 0.1, "1": 0.9}
LOW, HIGH, STEPS, TOLERANCE = 0.0, 4.0, 40, 1e-3
TRAIN_ROWS = 20_000  # bound of the labelled sample that the classifier is fitted to
BUCKETS, DETAIL = 8192, 1000  # hash buckets; steps that posteriors are rounded to


class Mixture(NamedTuple):
    """rows: docs with n_tokens, posteriors, rate and copies; expected tokens of each domain against its target."""

    rows: DataFrame
    domains: list[str]
    targets: list[float]
    totals: list[float]

    @property
    def residual(self) -> float:
        """The largest miss of a domain, as a share of all targets."""
        return max((abs(a - b) for a, b in zip(self.targets, self.totals, strict=True)), default=0.0) / max(1.0, sum(self.targets))


def words(text: Column) -> Column:
    """Runs without blanks, tabs or line ends."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), "\n\t\r", "   "), " "), "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def ending(word: Column) -> Column:
    """The bucket of a word's last two characters."""
    return F.pmod(F.xxhash64(F.lit("end"), F.substring(word, -2, 2)), F.lit(BUCKETS)).cast("int")


class Model(NamedTuple):
    """domains; for each but the first, a weight of every bucket against it (hundredths), and the regression's terms."""

    domains: list[str]
    weights: list[list[int]]
    terms: list[list[float]]


def bucket_weights(rows: DataFrame, domains: list[str]) -> list[list[int]]:
    """Log-odds of each bucket for each domain against the first; rows (w, y). At most BUCKETS x domains counts reach the driver."""
    some = rows.select("y", F.explode(F.concat(F.transform("w", bucket), F.transform("w", ending))).alias("b"))
    counts = [[1.0] * BUCKETS for _ in domains]
    for r in some.groupBy("y", "b").count().collect():
        counts[domains.index(r["y"])][r["b"]] += r["count"]
    total = [sum(c) for c in counts]
    log = [[math.log(n / t) for n in c] for c, t in zip(counts, total, strict=True)]
    return [[round(100 * (x - y)) for x, y in zip(one, log[0], strict=True)] for one in log[1:]]


def evidence(w: Column, weights: list[list[int]]) -> list[Column]:
    """Features of a text of words w: for each domain but the first its mean weight; a constant; the length."""
    n = F.greatest(F.size(w), F.lit(1)).cast("double")

    def mean(own: list[int]) -> Column:
        # One folded constant; a column for each number would be slow to plan.
        held = F.split(F.lit(",".join(map(str, own))), ",").cast("array<int>")
        return F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.get(held, bucket(x)) + F.get(held, ending(x))) / n / 100.0

    return [*(mean(own) for own in weights), F.lit(1.0), F.log1p(F.size(w).cast("double"))]


def softmax(z: list[Column]) -> list[Column]:
    """Posteriors from the log-odds against the first domain."""
    top = F.greatest(F.lit(0.0), *z) if z else F.lit(0.0)
    e = [F.exp(x - top) for x in (F.lit(0.0), *z)]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


def regression(rows: DataFrame, domains: list[str], width: int, *, rounds: int = 8, decay: float = 1e-2) -> list[list[float]]:
    """Multinomial logistic regression by Newton's method; rows (y, x: features). Each round is one aggregate."""
    k = len(domains) - 1
    theta = [[0.0] * width for _ in range(k)]
    at = [(i, j) for i in range(k) for j in range(width)]
    for _ in range(rounds):
        z = [sum((F.col("x")[j] * t for j, t in enumerate(own) if t), F.lit(0.0)) for own in theta]
        now = rows.select("y", "x", F.array(*softmax(z)).alias("p"))
        slope = [F.sum((F.col("p")[i + 1] - (F.col("y") == domains[i + 1]).cast("double")) * F.col("x")[j]).alias(f"g{i}_{j}") for i, j in at]
        bend = [F.sum(F.col("p")[a + 1] * (float(a == b) - F.col("p")[b + 1]) * F.col("x")[i] * F.col("x")[j]).alias(f"h{a}_{i}_{b}_{j}") for a, i in at for b, j in at]
        r = now.agg(*slope, *bend).first()
        if r["g0_0"] is None:
            return theta
        g = [r[f"g{i}_{j}"] + decay * theta[i][j] for i, j in at]
        h = [[r[f"h{a}_{i}_{b}_{j}"] + (decay if (a, i) == (b, j) else 0.0) for b, j in at] for a, i in at]
        step = solved(h, g)
        theta = [[theta[i][j] - step[i * width + j] for j in range(width)] for i in range(k)]
        if max(map(abs, step)) < 1e-6:
            break
    return theta


def fitted(docs: DataFrame, labels: DataFrame, *, domain: str, doc_id: str, text: str, train_rows: int = TRAIN_ROWS) -> Model:
    """The classifier, from about train_rows labelled documents at most, taken by a hash of the id."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col(domain).isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col(domain).cast("string")).alias("y"))
    marks = written(marks.withColumn("h", F.xxhash64("_id", F.lit("mixing"))), "marks")
    if (n := marks.count()) > train_rows:
        marks = marks.filter(F.pmod("h", F.lit(1 << 20)) < (1 << 20) * train_rows // n)
    marks = F.broadcast(marks)  # within train_rows
    rows = written(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).join(marks, "_id").select("y", "h", words(F.col("_t")).alias("w")), "labelled")
    domains = sorted(r["y"] for r in rows.select("y").distinct().collect())  # as many as domains
    if len(domains) < 2:
        return Model(domains or ["all"], [], [])
    odd = F.shiftrightunsigned(F.col("h"), 40) % 2 == 1
    weights = bucket_weights(rows.filter(odd), domains)
    x = written(rows.filter(~odd).select("y", F.array(*evidence(F.col("w"), weights)).alias("x")), "evidence")
    return Model(domains, weights, regression(x, domains, len(domains) + 1))


def posteriors(w: Column, model: Model) -> Column:
    """Array of the domains' posteriors in DETAIL-ths; the last is what the others leave."""
    x = evidence(w, model.weights)
    z = [sum((f * t for f, t in zip(x, own, strict=True)), F.lit(0.0)) for own in model.terms]
    p = [F.floor(v * DETAIL + 0.5).cast("int") for v in softmax(z)]
    return F.array(*p[:-1], F.lit(DETAIL) - sum(p[1:-1], p[0]) if p[1:] else F.lit(DETAIL))


def solved(m: list[list[float]], b: list[float]) -> list[float]:
    """x with m x = b, by elimination; m is small and positive."""
    a = [[*row, v] for row, v in zip(m, b, strict=True)]
    n = len(a)
    for i in range(n):
        k = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[k] = a[k], a[i]
        for r in range(n):
            if r != i:
                f = a[r][i] / a[i][i]
                a[r] = [x - f * y for x, y in zip(a[r], a[i], strict=True)]
    return [a[i][n] / a[i][i] for i in range(n)]


def rate(steps: list[list[float]], low: float, high: float, start: float) -> Column:
    """The rate after the steps so far, a fold over their vectors."""
    if not steps:
        return F.lit(float(start))
    width = len(steps[0])
    path = F.array(*(F.array(*(F.lit(float(x)) for x in s)) for s in steps))
    move = lambda s: sum((s[k] * F.col("_p")[k] for k in range(1, width)), s[0] * F.col("_p")[0])
    return F.aggregate(path, F.lit(float(start)), lambda r, s: F.least(F.greatest(r - move(s), F.lit(float(low))), F.lit(float(high))))


def shares(domains: list[str], weights: dict[str, float]) -> list[float]:
    share = [max(0.0, weights.get(d, 0.0)) for d in domains]
    return [s / sum(share) for s in share] if sum(share) > 0 else [1 / len(domains)] * len(domains)


def fit_rates(sums: DataFrame, targets: list[float], *, low: float, high: float, steps: int, tolerance: float) -> tuple[list[list[float]], list[float]]:
    """(step vectors, the totals that they reach) from sums (_n tokens, _p posteriors)."""
    k = len(targets)
    cell = lambda i, j: F.coalesce(F.sum(F.col("_n") * F.col("_p")[i] * F.col("_p")[j]), F.lit(0.0)).alias(f"m{i}_{j}")
    first = sums.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), *(cell(i, j) for i in range(k) for j in range(k))).first()
    total = float(first["n"])
    if not total:
        return [], [0.0] * k
    m = [[first[f"m{i}_{j}"] + (1e-6 * total if i == j else 0) for j in range(k)] for i in range(k)]
    path: list[list[float]] = []
    while True:
        r = rate(path, low, high, min(max(1.0, low), high))
        now = sums.withColumn("_now", r).agg(*(F.sum(F.col("_now") * F.col("_n") * F.col("_p")[i]).alias(f"t{i}") for i in range(k))).first()
        totals = [now[f"t{i}"] for i in range(k)]
        off = [t - want for t, want in zip(totals, targets, strict=True)]
        if max(map(abs, off)) <= 0.1 * tolerance * sum(targets) or len(path) == steps:
            return path, totals
        path.append(solved(m, off))


def mixed(docs: DataFrame, labels: DataFrame, *, domain: str = "quality", weights: dict[str, float] = WEIGHTS, low: float = LOW, high: float = HIGH, budget: float = 1.0, steps: int = STEPS, tolerance: float = TOLERANCE, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, train_rows: int = TRAIN_ROWS, seed: int = 17, prefix: str = "", strict: bool = False) -> Mixture:
    """docs (or their columns `carry`) with n_tokens, posteriors, rate and copies in place of columns of those names.

    The targets share budget x all tokens by weight.
    """
    model = fitted(docs, labels, domain=domain, doc_id=doc_id, text=text, train_rows=train_rows)
    names = {c: f"{prefix}{c}" for c in ("n_tokens", "posteriors", "rate", "copies")}
    own = docs.select("*", words(F.col(text)).alias("_w"), F.xxhash64(F.col(doc_id), F.col(text), F.lit(seed)).alias("_u"))
    own = own.withColumns({"_n": F.size("_w").cast("long"), "_k": posteriors(F.col("_w"), model)})
    kept = [c for c in carry or docs.columns if c not in names.values()]
    rows = written(own.select(*kept, "_n", "_k", "_u"), "posteriors")  # texts are split and scored here alone
    p = F.transform("_k", lambda x: x / float(DETAIL)).alias("_p")
    sums = written(rows.groupBy("_k").agg(F.sum("_n").alias("_n")).select("_n", p), "sums").coalesce(1)
    total = sums.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    targets = [budget * total * s for s in shares(model.domains, weights)]
    path, totals = fit_rates(sums, targets, low=low, high=high, steps=steps, tolerance=tolerance)
    u = F.pmod(F.col("_u"), F.lit(1 << 40)) / float(1 << 40)
    out = rows.select(*kept, F.col("_n").alias(names["n_tokens"]), p, "_u").withColumn("_r", rate(path, low, high, min(max(1.0, low), high)))
    out = out.select(*kept, names["n_tokens"], F.col("_p").alias(names["posteriors"]), F.col("_r").alias(names["rate"]), F.floor(F.col("_r") + u).cast("int").alias(names["copies"]))
    mix = Mixture(out, model.domains, targets, totals)
    if mix.residual > tolerance:
        what = f"no rates in [{low}, {high}] meet the targets {targets} of domains {model.domains}: totals {totals}"
        if strict:
            raise ValueError(what)
        warnings.warn(what, stacklevel=2)
    return mix


def repeated(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs, each row as often as it is drawn."""
    out = mixed(docs, labels, prefix="_", **how).rows
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixed(docs, table(spark, sf_dir, "labels"), carry=["doc_id"]).rows
