"""Benchmark decontamination by spaced-seed hashing (8). DataFrame functions only.

Texts are lower-cased runs of letters and digits. Fixed masks hash some words of a span and ignore the
others, so a window still meets its source where words were replaced. Windows of documents meet those of
benchmark items by hash; around each hit the two are laid over one another, and a document is contaminated
if `window` words in a row (the whole item, if shorter) agree but for `errors` substitutions (in proportion,
if shorter). The masks together meet 13 words whichever two were replaced (each at some place within them).
Shorter items get masks of their own length: each leaves out some blocks of it, so that one is whole
wherever the substitutions allowed fall.

The words around a window travel with it as hashes, so a hit is verified where it is found, a text is read
once for all masks, and only hashes of contaminated texts are gathered. Windows of the benchmark are
broadcast if there are at most `most_broadcast`, contaminated texts if at most MOST_FOUND; beyond that they
are joined by shuffle. Null and empty texts, on either side, have no windows. Texts that repeat are judged alike. An
empty benchmark leaves all clean.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

MASKS = ("1110100011", "1001111001")
WINDOW, ERRORS = 13, 2
MOST_BROADCAST, MOST_FOUND = 1_000_000, 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def block_masks(size: int, errors: int) -> list[str]:
    """Masks as long as an item; each keeps two of errors + 2 blocks, and errors leave two of them whole."""
    cut = [size * k // (errors + 2) for k in range(errors + 3)]
    kept = combinations(list(zip(cut, cut[1:], strict=False)), 2)
    masks = ("".join("1" if any(a <= k < b for a, b in two) else "0" for k in range(size)) for two in kept)
    return sorted({m for m in masks if "1" in m})


def windows(rows: DataFrame, key: str, masks: list[str], window: int, lead: int) -> DataFrame:
    """(key, i, h, near) from rows with `ws` and `n`: place and hash of every window under every mask, with the
    hashed words around it, from `lead` before to `window` after its first (null beyond an end).

    Words are hashed once; shifted copies of those hashes, laid side by side, become columns, so that the
    windows' own hashes are plain columns of generated code.
    """
    at = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>")).alias("i")
    none = F.array_repeat(F.lit(None).cast("long"), lead)
    coded = rows.select(key, "n", F.concat(none, F.transform("ws", lambda w: F.xxhash64(w))).alias("hs"))
    shifted = (F.slice("hs", k + 1, "n").alias(f"c{k}") for k in range(lead + window))
    # Of an outer generator no filter on its array is inferred, which would cut every text into words again.
    flat = coded.select(key, "n", F.arrays_zip(at, *shifted).alias("z")).select(key, "n", F.inline_outer("z"))
    one = lambda m: F.when(F.col("i") + len(m) <= F.col("n"), F.xxhash64(F.lit(m), *(F.col(f"c{lead + k}") for k, c in enumerate(m) if c == "1")))
    columns = [f"c{k}" for k in range(lead + window)]
    each = flat.select(key, "i", *columns, F.explode(F.array(*map(one, masks))).alias("h")).filter(F.col("h").isNotNull())
    return each.select(key, "i", "h", F.array(*columns).alias("near"))


def tokenised(df: DataFrame, text: str, *keep) -> DataFrame:
    return df.filter(F.col(text).isNotNull()).select(*keep, words(F.col(text)).alias("ws")).withColumn("n", F.size("ws"))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str, item_id: str, item_text: str, masks, window: int, errors: int, most_broadcast: int) -> DataFrame:
    """(tk, found): of each text (by its hash) that agrees with an item, the sorted ids. Texts are read once and verified on the spot."""
    items = written(tokenised(benchmark, item_text, F.col(item_id).alias("item")).filter("n > 0"), "items")
    short = [r["n"] for r in items.filter(F.col("n") < window).select("n").distinct().collect()]  # fewer than the window
    groups = [(F.col("n") >= window, list(masks)), *((F.col("n") == n, block_masks(n, n * errors // window)) for n in sorted(short))]
    used = sorted({m for _, own in groups for m in own})
    lead = window - min(map(len, used))
    index = None
    for which, own in groups:
        some = windows(items.filter(which), "item", own, window, lead).select("h", "item", F.col("near").alias("of_item"))
        index = some if index is None else index.unionByName(some)
    index = written(index.distinct(), "index")
    index = F.broadcast(index) if index.count() <= most_broadcast else index
    met = windows(tokenised(docs, text, F.xxhash64(text).alias("tk")), "tk", used, window, lead).join(index, "h")
    good = met.filter(agrees(F.col("near"), F.col("of_item"), window, errors)).select("tk", "item").distinct()
    return written(good.groupBy("tk").agg(F.array_sort(F.collect_list("item")).alias("found")), "found")


def agrees(own: Column, item: Column, window: int, errors: int) -> Column:
    """Does some stretch of `window` words of the item (the whole item, if shorter) agree? Both are laid on one another; null is beyond an end."""
    there = F.transform(item, lambda y: F.when(y.isNotNull(), 1).otherwise(0))
    same = F.zip_with(own, item, lambda x, y: F.when(x == y, 1).otherwise(0))
    total = lambda c, s, n: F.aggregate(F.slice(c, s, n), F.lit(0), lambda a, x: a + x)
    whole = total(there, F.lit(1), F.size(item))  # of a longer item at least `window` words show, or its end does
    w = F.least(whole, F.lit(window))
    allowed = F.floor(w * errors / window).cast("int")
    return F.exists(F.sequence(F.lit(1), F.size(item) - w + 1), lambda s: (total(there, s, w) == w) & (total(same, s, w) >= w - allowed))


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", masks=MASKS, window: int = WINDOW, errors: int = ERRORS, most_broadcast: int = MOST_BROADCAST, name: str = "items") -> DataFrame:
    """docs with `items`, the sorted ids of benchmark items found (empty: clean), in place of a column of that name."""
    found = contaminated(docs, benchmark, text=text, item_id=item_id, item_text=item_text, masks=masks, window=window, errors=errors, most_broadcast=most_broadcast)
    found = F.broadcast(found) if found.count() <= MOST_FOUND else found
    kind = f"array<{dict(benchmark.dtypes)[item_id]}>"
    rows = docs.withColumn("_tk", F.when(F.col(text).isNotNull(), F.xxhash64(text))).join(found.select(F.col("tk").alias("_tk"), F.col("found").alias("_found")), "_tk", "left").drop("_tk")
    return rows.withColumn(name, F.coalesce("_found", F.array().cast(kind))).drop("_found")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the contaminated ones."""
    return contamination(docs, benchmark, name="_items", **how).filter(F.size("_items") == 0).drop("_items")


def query(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), "items")
