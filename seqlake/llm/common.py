"""Shared folder, row keys, components: what several training-data operators need."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEW, AUTO_MB = 100_000, 2  # rows, and MB of a file or shuffle, that the driver may build a broadcast of
BITS = 1 << 25  # of the bits that stand for a set of keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; in local mode one of our own where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        own = tempfile.mkdtemp(prefix="seqlake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, *, codec: str = "zstd") -> DataFrame:
    """Cut lineage: a table in the shared folder, read again. Survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: int = 500) -> None:
    """From here on the session hands Python at most `most` rows at once: whole texts of thousands of rows, on both sides, would fill an executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))


def small_broadcasts(spark: SparkSession, most: int = AUTO_MB) -> None:
    """From here on the session itself chooses only tables of up to `most` MB, compressed, for a broadcast: the driver holds several at once, unpacked."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    now = spark.conf.get(name)
    if not now.startswith("-") and spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > most << 20:
        spark.conf.set(name, f"{most}m")


def text_key(text: Column) -> Column:
    """128 bits of a text, the same in every run and retry; null and empty texts differ."""
    return F.md5(F.coalesce(F.concat(F.lit("t"), text), F.lit("")))


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits of id and text. Rows that repeat both share it, and every result below depends on both alone."""
    return F.md5(F.concat_ws("\x01", F.coalesce(doc_id.cast("string"), F.lit("\x02")), F.coalesce(text, F.lit("\x02"))))


def salted_join(rows: DataFrame, few: DataFrame, on: list[str], by: Column, *, salts: int = 8) -> DataFrame:
    """rows joined with `few`, which has each key once: a key with a third of the rows is dealt to `salts` tasks by `by`.

    What a broadcast or Spark's own splitting of skewed joins makes needless costs `few` x salts small rows.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.array(*(F.lit(k) for k in range(salts)))))
    return left.join(right, [*on, "_salt"]).drop("_salt")


def few(rows: DataFrame, *, by: DataFrame | None = None, most: int = FEW, weight: Column | None = None) -> DataFrame:
    """rows, marked to go to every task if a written table (`by`, or they themselves) has up to `most`: what they are joined with stays where it is.

    The driver builds what is broadcast, so `most` must not grow with the input; rows that hold lists count by `weight`.
    """
    of = rows if by is None else by
    n = of.count() if weight is None else of.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(rows) if n <= most else rows


def holding(rows: DataFrame, on: str, ids: DataFrame) -> DataFrame:
    """Those of the rows whose `on`, a key, may be among the ids (one column): all that are, and few others.

    The ids become BITS bits, 4 MB on the driver and in a task however many they are, so rows need not move to be dropped.
    """
    import numpy as np
    import pyarrow as pa

    at = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(BITS))
    one = F.expr("shiftleft(1L, cast(_at % 64 as int))")
    found = ids.select(at.alias("_at")).groupBy(F.floor(F.col("_at") / 64).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, "i8")
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    parts = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bits) + 1, 1024), pa.int32()), pa.array(bits))
    held = rows.sparkSession.createDataFrame(pa.table({"_part": pa.array(np.arange(len(parts)), pa.int64()), "_bits": parts}))
    rows = rows.withColumn("_at", F.pmod(F.xxhash64(on), F.lit(BITS))).withColumn("_part", F.floor(F.col("_at") / 65536))
    return rows.join(F.broadcast(held), "_part").filter("shiftright(get(_bits, cast(_at div 64 % 1024 as int)), cast(_at % 64 as int)) & 1 = 1").drop("_part", "_at", "_bits")


def least_nodes(edges) -> dict:
    """The least node of the component of every node of the edges."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def components(edges: DataFrame, a: str = "a", b: str = "b", *, most_rounds: int = 60, most_local: int = 50_000) -> DataFrame:
    """(node, label): the least node of each connected component, for every node of an edge.

    Up to `most_local` edges are joined on the driver. Beyond, each round takes the least label around a node (a map-side-combined aggregate, so a node with a
    third of all edges is no hot task), then the label of that label. Rounds grow with the logarithm
    of the diameter; the label table is cut by a written table each round.
    """
    if edges.count() <= most_local:
        few = edges.select(a, b).toArrow()
        found = least_nodes(zip(*(few.column(c).to_pylist() for c in (a, b)), strict=True))
        return edges.sparkSession.createDataFrame(list(found.items()), "node long, label long")
    both = written(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
        .select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        .select("e.u", "e.v").distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, F.col("v") == F.col("node")).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        one = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("one"))
        up = labels.select(F.col("node").alias("one"), F.col("label").alias("two"))
        new = written(one.join(up, "one", "left").select("node", F.least("one", F.coalesce("two", "one")).alias("label"), F.col("label").alias("old")), "labels")
        changed = new.filter("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
