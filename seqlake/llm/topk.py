"""Exact top-k by inner product with block-at-a-time pruning (3).

Rows, in ranges of ids, are packed into forward-index rows of `pack` vectors, made of small blocks with the
maxima and minima of every component (term). Queries come in chunks. A chunk keeps its queries' k best so
far from one packed row to the next: each query takes a row's blocks by their summed term maxima, best
first, and scores whole blocks until the next bound falls below its k-th score. The k-th score among a
bounded sample of rows (`seeds`) is where it starts, so most blocks are never scored. A block that only
ties is scored, so ties go to smaller ids.

Packed rows and chunks are dealt to a grid of cells, about as many as shuffle partitions: with P of them,
each side is copied sqrt(P) times, and a query hands on k rows from each of sqrt(P) cells.

Vectors that are null, or hold a component that is null or not finite (also after scaling), take no part;
shorter vectors count as padded with zeros. Sums are exact: in doubles where none can round, else in 64-bit
integers, else (components of 2**31 or more, packed apart) in Python's; a score beyond 64 bits counts as
the nearest 64-bit number. Rows with the query's own id are no
candidates. Repeated candidate rows count each; a repeated query row is asked once. No queries or no rows:
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEEDS = 1024
PACKED = "wide boolean, width int, ids binary, keys binary, m binary"
OUT = "query_id long, query_key long, vec_id long, score long"


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v array<double>): floor(scale * x) of usable vectors."""
    x = F.transform(F.col(vec_col), lambda x: x.cast("double") * F.lit(float(scale)))
    ok = F.forall("_x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # floor() gives a long, which large doubles overflow; those are whole numbers as they are.
    whole = F.transform("_x", lambda x: F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x))
    return df.select(F.col(id_col).cast("long").alias("id"), x.alias("_x")).filter(F.col("id").isNotNull() & F.col("_x").isNotNull() & ok).select("id", whole.alias("v"))


def _packer(size: int):
    def run(batches):
        """Rows (id, key, v) in order as packed rows: ids, keys and a matrix; wide components apart."""
        import numpy as np
        import pyarrow as pa

        def row(wide, held):
            ids, keys, vs = zip(*held, strict=True)
            m = np.zeros((len(ids), max(map(len, vs))), "<f8" if wide else "<i4")
            for i, v in enumerate(vs):
                m[i, : len(v)] = v
            raw = [pa.array([x], pa.binary()) for x in (np.array(ids, "<i8").tobytes(), np.array(keys, "<i8").tobytes(), m.tobytes())]
            return pa.RecordBatch.from_arrays([pa.array([wide]), pa.array([m.shape[1]], pa.int32()), *raw], ["wide", "width", "ids", "keys", "m"])

        held = {False: [], True: []}
        for b in batches:
            flat, offs = b.column("v").flatten().to_numpy(zero_copy_only=False), np.asarray(b.column("v").offsets)
            offs = offs - offs[0]
            for i, (own, key) in enumerate(zip(b.column("id").to_pylist(), b.column("key").to_pylist(), strict=True)):
                v = flat[offs[i] : offs[i + 1]]
                wide = bool(len(v)) and bool(np.abs(v).max() >= 2.0**31)
                held[wide].append((own, key, v))
                if len(held[wide]) == size:
                    yield row(wide, held[wide])
                    held[wide] = []
        for wide, rest in held.items():
            if rest:
                yield row(wide, rest)

    return run


def unpacked(wide: bool, width: int, ids: bytes, keys: bytes, m: bytes):
    import numpy as np

    n = len(ids) // 8
    return np.frombuffer(ids, "<i8"), np.frombuffer(keys, "<i8"), np.frombuffer(m, "<f8" if wide else "<i4").reshape(n, width)


def exact(m, q):
    """Both matrices, of one width, in a type whose inner products are exact."""
    import numpy as np

    width = max(m.shape[1], q.shape[1])
    m, q = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (m, q))
    most = width * max(1.0, float(np.abs(m).max(initial=0))) * max(1.0, float(np.abs(q).max(initial=0)))
    if most < 2.0**53:
        return m.astype("f8"), q.astype("f8")
    if most < 2.0**62:
        return m.astype("i8"), q.astype("i8")
    whole = lambda x: np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
    return whole(m), whole(q)


class Best:
    """The k best so far of each query of a chunk: scores, ids; `least` is what a row must reach."""

    def __init__(self, ids, keys, q, k: int):
        import numpy as np

        self.ids, self.keys, self.q, self.k = ids, keys, q, k
        self.least = np.full(len(ids), -(1 << 63), "i8")
        self.who, self.score, self.row = (np.zeros(0, "i8") for _ in range(3))

    def keep(self, who, score, row) -> None:
        """Take in candidates; cut to k a query by score, then smaller id."""
        import numpy as np

        who, score, row = (np.concatenate(x) for x in ((self.who, who), (self.score, score), (self.row, row)))
        o = np.lexsort((row, ~score, who))
        who, score, row = who[o], score[o], row[o]
        good = np.arange(len(who)) - np.searchsorted(who, np.arange(len(self.ids)))[who] < self.k
        self.who, self.score, self.row = who[good], score[good], row[good]
        n = np.bincount(self.who, minlength=len(self.ids))
        full = n >= self.k
        reached = self.score[np.cumsum(n)[full] - 1]
        self.least[full] = np.maximum(self.least[full], reached)

    def seed(self, ids, m) -> None:
        """Start from the k-th score among some rows, which are not kept: they come again."""
        import numpy as np

        m, q = exact(m, self.q)
        s = q @ m.T
        for i in range(len(self.ids)):
            own = np.sort(s[i][ids != self.ids[i]])
            if len(own) >= self.k:
                self.least[i] = max(-(1 << 63), min((1 << 63) - 1, int(own[-self.k])))

    def scan(self, ids, m, block: int) -> None:
        """Packed rows, block by block, best bound first."""
        import numpy as np

        m, q = exact(m, self.q)
        starts = range(0, len(ids), block)
        low, high = (np.array([f(m[i : i + block], axis=0) for i in starts]) for f in (np.min, np.max))
        bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        order = np.argsort(-bound, axis=1, kind="stable")
        open_ = np.ones(len(q), bool)
        top = (1 << 63) - 1
        # Scores in doubles stay below 2**53, so a larger bound that is rounded parts them the same.
        least = lambda: self.least.astype("f8") if bound.dtype == "f8" else self.least
        for rank in range(order.shape[1]):
            at = order[:, rank]
            open_ &= (bound[np.arange(len(q)), at] >= least()).astype(bool)
            if not open_.any():
                return
            parts, now = [], least()
            for x in np.unique(at[open_]):
                who = np.nonzero(open_ & (at == x))[0]
                rows = slice(x * block, (x + 1) * block)
                s = q[who] @ m[rows].T
                i, j = np.nonzero((s >= now[who, None]).astype(bool) & (ids[None, rows] != self.ids[who, None]))
                got = np.array([max(-top - 1, min(top, x)) for x in s[i, j]], "i8") if s.dtype == object else s[i, j].astype("i8")
                parts.append((who[i], got, ids[rows][j]))
            if any(len(p[0]) for p in parts):
                self.keep(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def _scorer(k: int, block: int, seeds, most_held: int = 64):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[int, Best] = {}

        def given(best):
            score = np.array([int(s) for s in best.score], "i8")
            return pa.RecordBatch.from_arrays([pa.array(best.ids[best.who]), pa.array(best.keys[best.who]), pa.array(best.row), pa.array(score)], ["query_id", "query_key", "vec_id", "score"])

        sample = [unpacked(*x) for x in seeds.value]
        for b in batches:
            for r in b.to_pylist():
                best = held.pop(r["chunk"], None)
                if best is None:
                    best = Best(*unpacked(r["q_wide"], r["q_width"], r["q_ids"], r["q_keys"], r["q_m"]), k)
                    for ids, _, m in sample:
                        best.seed(ids, m)
                held[r["chunk"]] = best  # the latest stands last
                ids, _, m = unpacked(r["wide"], r["width"], r["ids"], b"", r["m"])
                best.scan(ids, m, block)
                if len(held) > most_held:
                    yield given(held.pop(next(iter(held))))
        for best in held.values():
            yield given(best)

    return run


def top_k(rows: DataFrame, queries: DataFrame, *, k: int = 20, pack: int = 1024, chunk: int = 256, block: int = 64, seeds: int = SEEDS) -> DataFrame:
    """rows, queries: (id, v array<double> of whole numbers). Returns query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    keyed = lambda df: df.select("id", F.xxhash64("v").alias("key"), "v")
    some = keyed(rows).orderBy(F.xxhash64("id", "key"), "id").limit(seeds)  # a top-k over hashes: few rows a task
    sample = spark.sparkContext.broadcast([tuple(r) for r in some.coalesce(1).mapInArrow(_packer(seeds), PACKED).collect()])  # at most `seeds` vectors
    side = max(1, round(int(spark.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    cells = lambda: F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    packed = keyed(rows).repartitionByRange("id", "key").sortWithinPartitions("id", "key").mapInArrow(_packer(pack), PACKED)
    packed = packed.withColumn("a", F.pmod(F.xxhash64("ids", "keys"), F.lit(side)).cast("int")).withColumn("b", cells()).drop("keys")
    asked = keyed(queries).dropDuplicates(["id", "key"])
    asked = asked.mapInArrow(_packer(chunk), PACKED).select(*(F.col(c).alias(f"q_{c}") for c in ("wide", "width", "ids", "keys", "m")))
    asked = asked.withColumn("chunk", F.xxhash64("q_ids", "q_keys", "q_m")).withColumn("b", F.pmod("chunk", F.lit(side)).cast("int")).withColumn("a", cells())
    met = asked.join(packed, ["a", "b"]).select("chunk", "q_wide", "q_width", "q_ids", "q_keys", "q_m", "wide", "width", "ids", "m")
    best = met.mapInArrow(_scorer(k, block, sample), OUT)
    w = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    v = integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return top_k(v, v.filter("id % 20 = 0"))


def sql() -> str:
    return """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
