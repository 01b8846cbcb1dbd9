"""Line dedup by a log-template tree (10).

Each line goes down a tree of fixed depth: its number of tokens, then its leading tokens (a token with a
digit is a variable, `<*>`). In a leaf the tokens after the leading ones are cut into up to `blocks` blocks;
a template leaves up to `wild` of them open, together at most the share 1 - `alike` of the line's tokens, and
takes in every line of the leaf that has its other tokens. Lines under `least` tokens have no open blocks. A
template seen in `min_docs` documents or more recurs, and its lines are dropped everywhere.

So a line's templates are fixed by the line alone, and a template is a key to count by: leaves of any size
are dealt by template, not whole, and neither the order of lines nor the number of partitions has a bearing
on the result. Only leaves that `min_docs` documents reach, and templates that two different lines share, go
on to the count of documents; a line's own recurrence is counted besides. Keys are 64-bit hashes (of lines
together with their leaf's). Lines are what stands between "\n"; blank lines are kept and not counted.
Null texts stay null, with no lines. Repeated rows (id and text) count as one document and get the same
result. Rows with different ids or texts are different documents.
"""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, salted_join, table, written

DEPTH, ALIKE, MIN_DOCS = 3, 0.7, 4
LEAST, BLOCKS, WILD = 6, 8, 3
VARIABLE = "<*>"
DIGIT = re.compile(r"\d")


def masked(line: str) -> list[str]:
    tokens = line.split()
    return [VARIABLE if DIGIT.search(t) else t for t in tokens] if DIGIT.search(line) else tokens


def _lines(depth: int):
    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest as h

        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for b in batches:
            keys, no, leaf, line, text = [], [], [], [], []
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, s in enumerate(t.split("\n")):
                    tokens = masked(s)
                    if tokens:
                        m = " ".join(tokens)
                        keys.append(key)
                        no.append(i)
                        leaf.append(signed(h(f"{len(tokens)} {' '.join(tokens[:depth])}")))
                        line.append(signed(h(m)))
                        text.append(m)
                if len(keys) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(no, pa.int32()), pa.array(leaf, pa.int64()), pa.array(line, pa.int64()), pa.array(text, pa.string())], ["key", "no", "leaf", "line", "masked"])
                    keys, no, leaf, line, text = [], [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(no, pa.int32()), pa.array(leaf, pa.int64()), pa.array(line, pa.int64()), pa.array(text, pa.string())], ["key", "no", "leaf", "line", "masked"])

    return run


def open_blocks(size: int, depth: int, alike: float, least: int, blocks: int, wild: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """(where the blocks of a line of `size` tokens begin and the last ends, the sets of blocks that its templates leave open).

    Sets that lie within another one are left out: who agrees on more agrees on less.
    """
    rest = size - depth
    most = int((1 - alike) * size + 1e-9)
    if size < least or rest < 1 or most < 1:
        return [], []
    n = min(rest, blocks)
    cut = [depth + rest * k // n for k in range(n + 1)]
    width = lambda s: sum(cut[k + 1] - cut[k] for k in s)
    fit = [s for w in range(1, min(wild, n) + 1) for s in combinations(range(n), w) if width(s) <= most]
    return cut, [s for s in fit if not any(set(s) < set(t) for t in fit)]


def template_keys(tokens: list[str], depth: int, cut: list[int], sets: list[tuple[int, ...]]) -> list[int]:
    """A key for each template of a masked line; cut and sets as open_blocks() gives them for its size."""
    from xxhash import xxh3_64_intdigest as h

    if not sets:
        return []
    own = [h(" ".join(tokens[a:b]), k + 1) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False))]
    whole = h(f"{len(tokens)} {' '.join(tokens[:depth])}")
    for x in own:
        whole ^= x
    keys = []
    for no, s in enumerate(sets):
        key = whole
        for k in s:
            key ^= own[k]
        keys.append(h(key.to_bytes(8, "little"), no))
    return keys


def _keys(depth: int, *how):
    def run(batches):
        """Rows (leaf, line, masked) to (leaf, line, template)."""
        import numpy as np
        import pyarrow as pa

        shapes: dict[int, tuple] = {}  # by size

        def keys(line):
            tokens = line.split(" ")
            if len(tokens) not in shapes:
                shapes[len(tokens)] = open_blocks(len(tokens), depth, *how)
            return template_keys(tokens, depth, *shapes[len(tokens)])

        for b in batches:
            for at in range(0, b.num_rows, 2000):
                some = b.slice(at, 2000)
                made = [keys(t) for t in some.column("masked").to_pylist()]
                of = pa.array(np.repeat(np.arange(len(made)), [len(k) for k in made]))
                flat = pa.array(np.array([k for ks in made for k in ks], "u8").view("i8"))
                yield pa.RecordBatch.from_arrays([some.column("leaf").take(of), some.column("line").take(of), flat], ["leaf", "line", "template"])

    return run


def recurring(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, alike: float = ALIKE, min_docs: int = MIN_DOCS, least: int = LEAST, blocks: int = BLOCKS, wild: int = WILD):
    """(lines, dropped): every line (key, no, leaf, line), and the (leaf, line) that recur."""
    own = docs.filter(F.col(text).isNotNull()).select(row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(text).alias("text"))
    lines = written(own.mapInArrow(_lines(depth), "key string, no int, leaf long, line long, masked string"), "lines")
    reach = written(lines.select("leaf", "line", F.xxhash64("key").alias("doc")).distinct(), "reach")
    exact = reach.groupBy("leaf", "line").agg(F.count("*").alias("docs"))
    exact = written(exact, "exact")
    leaves = reach.select("leaf", "doc").distinct().groupBy("leaf").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs).select("leaf")
    many = written(exact.groupBy("leaf").agg(F.count("*").alias("kinds")).filter("kinds > 1").join(leaves, "leaf").select("leaf"), "leaves")
    some = salted_join(lines.select("leaf", "line", "masked"), many, ["leaf"], F.col("line"))
    some = some.groupBy("leaf", "line").agg(F.first("masked").alias("masked"))
    keys = written(some.mapInArrow(_keys(depth, alike, least, blocks, wild), "leaf long, line long, template long"), "keys")
    shared = keys.groupBy("template").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("template")
    keys = written(salted_join(keys, shared, ["template"], F.col("line")), "keys")
    # A line of many documents meets its few templates here, so its documents are dealt, not the templates.
    docs_of = salted_join(reach, keys.groupBy("leaf", "line").agg(F.collect_list("template").alias("templates")), ["leaf", "line"], F.col("doc"))
    seen = docs_of.select(F.explode("templates").alias("template"), "doc").distinct().groupBy("template").agg(F.count("*").alias("docs"))
    often = written(seen.filter(F.col("docs") >= min_docs).select("template"), "recurring")
    general = salted_join(keys, often, ["template"], F.col("line")).select("leaf", "line")
    dropped = written(exact.filter(F.col("docs") >= min_docs).select("leaf", "line").unionByName(general).distinct(), "dropped")
    return lines.select("key", "no", "leaf", "line"), dropped


def without_templates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with recurring lines out of column `text`; n_lines counts lines that are not blank, n_dropped those that went."""
    lines, dropped = recurring(docs, doc_id=doc_id, text=text, **how)
    gone = written(salted_join(lines, dropped, ["leaf", "line"], F.col("key")).groupBy("key").agg(F.collect_set("no").alias("_gone")), "gone")
    rows = docs.withColumn("_key", row_key(F.col(doc_id), F.col(text))).join(gone.withColumnRenamed("key", "_key"), "_key", "left")
    parts = F.split(F.col(text), "\n", -1)
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("_gone", i)), "\n")
    count = F.size(F.filter(parts, lambda x: x.rlike(r"(?U)\S")))
    return rows.withColumns({
        "n_lines": F.coalesce(count, F.lit(0)).cast("long"),
        "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
        text: F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept),
    }).drop("_key", "_gone")


def query(spark, sf_dir: str) -> DataFrame:
    out = without_templates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))
