"""Personal data, secrets, and terms that reveal a protected entity (6).

Base spans (email, ip, card, phone) are found by pattern and check. Every base value is a protected
entity; the words within `window` words of it are its candidate terms. Over the corpus, with N texts of
which c(e) hold entity e, a term t tells of it the pointwise information log(N c(e,t) / (c(e) c(t))), at most
log(N / c(e)), all that there is to know of e. Terms that tell at least the share `disclosure` of that, from
at least `min_texts` texts, are generalised wherever they occur, or removed if they tell `removal` of it or
more. A secret is a run of 20 or more letters, digits and signs whose own characters hold `bits` of
information or more, digits and letters among them.

Told terms are broadcast if there are at most `most_told`; beyond that each text is joined with its own.
Null and empty texts have no spans. Rows that repeat count each and get the same spans. Terms never overlap
base spans or secrets, nor secrets base spans. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, table, written

KINDS = ("email", "ip", "card", "phone", "term", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match cannot start within a run of digits that one from its start did not take, hence the look-behind.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")
SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+")
WINDOW, REACH = 8, 160
BITS = 64
MOST_TOLD = 200_000
MIN_TEXTS, DISCLOSURE, REMOVAL = 2, 0.8, 0.95


def emails(text: str):
    """What `[local]+@[host]+(\\.[host]+)+` finds from the left: each match is fixed by its @."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end), by start, then kind."""
    if not text:
        return []
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub(r"[^0-9]", "", m.group()) if 14 <= m.end() - m.start() <= 40 else ""
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(text: str, span: tuple[int, int, int]) -> str:
    a, kind, b = span
    value = text[a:b].lower()
    return f"{KINDS[kind]}:{value if kind < 2 else re.sub('[^0-9]', '', value)}"


def secrets(text: str, base, bits: float) -> list[tuple[int, int, int]]:
    """(start, kind, end) of runs that hold `bits` of information, outside the base spans."""
    out = []
    for m in SECRET.finditer(text):
        run = m.group()
        if not (any("0" <= c <= "9" for c in run) and any(c.isalpha() for c in run)):
            continue
        if any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        n = len(run)
        if -sum(c * math.log2(c / n) for c in Counter(run).values()) >= bits:
            out.append((m.start(), 5, m.end()))
    return out


def terms_near(text: str, spans, window: int) -> set[tuple[str, str]]:
    """(entity, term) of words around the base spans; words are runs of letters."""
    out = set()
    for a, kind, b in spans:
        e = entity(text, (a, kind, b))
        low = max(0, a - REACH)
        near = [m for m in WORD.finditer(text, low, a) if m.start() > low or low == 0][-window:]
        near += [m for m in WORD.finditer(text, b, min(len(text), b + REACH)) if m.end() < b + REACH or m.end() == len(text)][:window]
        out |= {(e, m.group().lower()) for m in near if m.group().isalpha() and not any(s < m.end() and m.start() < t for s, _, t in spans)}
    return out


def _finder(window: int):
    def run(batches):
        """Texts with base spans: their entities, and the terms near them."""
        import pyarrow as pa

        pair = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())]))
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                entities, near = [], []
                for t in b.column(0).slice(at, 1000).to_pylist():
                    if found := base_spans(t):
                        entities.append(sorted({entity(t, x) for x in found}))
                        near.append([{"entity": e, "term": w} for e, w in sorted(terms_near(t, found, window))])
                yield pa.RecordBatch.from_arrays([pa.array(entities, pa.list_(pa.string())), pa.array(near, pair)], ["entities", "near"])

    return run


def told_terms(docs: DataFrame, *, text: str, window: int, min_texts: int, disclosure: float, removal: float) -> DataFrame:
    """(term, removed) of terms that disclose an entity."""
    n = docs.count()
    found = written(docs.select(F.col(text).cast("string").alias("_text")).mapInArrow(_finder(window), "entities array<string>, near array<struct<entity:string,term:string>>"), "found")
    c_e = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("c_e")).filter((F.col("c_e") >= min_texts) & (F.col("c_e") < n))
    c_et = found.select(F.explode("near").alias("x")).groupBy("x.entity", "x.term").agg(F.count("*").alias("c_et")).filter(F.col("c_et") >= min_texts)
    maybe = written(c_et.join(c_e, "entity"), "maybe")
    # Of an outer generator no filter on its array is inferred, which would cut every text twice.
    words = docs.select(F.explode_outer(F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}]+"))).alias("term")).groupBy("term").agg(F.count("*").alias("c_t"))
    words = words.join(maybe.select("term").distinct(), "term")
    share = F.log(F.col("c_et") * F.lit(float(n)) / (F.col("c_e") * F.greatest(F.coalesce("c_t", "c_et"), "c_et"))) / F.log(F.lit(float(n)) / F.col("c_e"))
    told = maybe.join(words, "term", "left").withColumn("share", share).filter(F.col("share") >= disclosure)
    return written(told.groupBy("term").agg(F.max(F.col("share") >= removal).alias("removed")), "told")


MARKED = "base array<struct<s:int,k:int,e:int>>, terms array<struct<s:int,k:int,e:int,removed:boolean>>, secrets array<struct<s:int,k:int,e:int>>"


def _marker(told, bits: float):
    def run(batches):
        """Every span of each text; told: of all texts, or None where each row has its own in _told."""
        import pyarrow as pa

        plain = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))
        more = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32()), ("removed", pa.bool_())]))
        every = told.value if told else None
        rows = lambda found: [{"s": s, "k": k, "e": e} for s, k, e in found]
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                some = b.slice(at, 1000)
                base, terms, own = [], [], []
                few = [None] * some.num_rows if every is not None else some.column("_told").to_pylist()
                for t, x in zip(some.column("_text").to_pylist(), few, strict=True):
                    known = every if every is not None else {r["term"]: r["removed"] for r in x or ()}
                    found = base_spans(t)
                    keys = secrets(t, found, bits) if t else []
                    base.append(rows(found))
                    own.append(rows(keys))
                    taken, marks = [*found, *keys], []
                    for m in WORD.finditer(t) if t and known else ():
                        gone = known.get(m.group().lower())
                        if gone is not None and m.group().isalpha() and not any(s < m.end() and m.start() < e for s, _, e in taken):
                            marks.append({"s": m.start(), "k": 4, "e": m.end(), "removed": gone})
                    terms.append(marks)
                left = some.drop_columns([c for c in ("_text", "_told") if c in some.schema.names])
                yield left.append_column("base", pa.array(base, plain)).append_column("terms", pa.array(terms, more)).append_column("secrets", pa.array(own, plain))

    return run


def spans(docs: DataFrame, *, carry: tuple[str, ...] = ("doc_id",), text: str = "text", window: int = WINDOW, min_texts: int = MIN_TEXTS, disclosure: float = DISCLOSURE, removal: float = REMOVAL, bits: float = BITS, most_told: int = MOST_TOLD) -> DataFrame:
    """Columns `carry`, base and secrets (s, k, e) and terms (s, k, e, removed) of every row."""
    told = told_terms(docs, text=text, window=window, min_texts=min_texts, disclosure=disclosure, removal=removal)
    rows = docs.select(*carry, F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    if told.count() <= most_told:
        sent = docs.sparkSession.sparkContext.broadcast({r["term"]: r["removed"] for r in told.collect()})
        return rows.mapInArrow(_marker(sent, bits), f"{kinds}, {MARKED}")
    own = docs.filter(F.col(text).isNotNull()).select(F.md5(F.col(text)).alias("_tk"), F.explode_outer(F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}]+"))).alias("term"))
    own = own.join(told, "term").distinct().groupBy("_tk").agg(F.collect_list(F.struct("term", "removed")).alias("_told"))
    rows = rows.withColumn("_tk", F.md5("_text")).join(own, "_tk", "left").drop("_tk")
    return rows.mapInArrow(_marker(None, bits), f"{kinds}, {MARKED}")


def sanitised(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with base spans and secrets as [EMAIL] and so on, and terms as [TERM] or removed, in column `text`."""
    own = docs.withColumn("_row", row_key(F.col(doc_id), F.col(text)))
    kept = lambda c: F.transform(c, lambda b: F.struct(b["s"].alias("s"), b["k"].alias("k"), b["e"].alias("e"), F.lit(False).alias("removed")))
    found = spans(own, carry=("_row",), text=text, **how).dropDuplicates(["_row"]).select("_row", F.array_sort(F.concat(kept("base"), kept("secrets"), "terms")).alias("_spans"))
    out = own.join(written(found.filter("size(_spans) > 0"), "spans"), "_row", "left").drop("_row")

    @F.pandas_udf("string")
    def redact(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, found):
            parts, at = [], 0
            for x in found if t is not None and found is not None else ():
                if x["s"] >= at:
                    parts += [t[at : x["s"]], "" if x["removed"] else f"[{KINDS[x['k']].upper()}]"]
                    at = x["e"]
            return t if t is None else "".join([*parts, t[at:]])

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)])

    return out.withColumn(text, redact(F.col(text), "_spans")).drop("_spans")


def query(spark, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    name = F.array(*(F.lit(k) for k in KINDS))
    line = lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))
    plain = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    every = F.array_sort(F.concat("base", F.transform("terms", plain), "secrets"))
    size = lambda c: F.size(c).cast("long")
    return found.select(
        "doc_id", *map(count, range(4)), F.sha2(F.array_join(F.transform("base", line), ","), 256).alias("base_sha256"), F.array_join(F.transform(every, line), ",").alias("spans"),
        size("terms").alias("n_term"), size("secrets").alias("n_secret"), (size("base") + size("secrets")).alias("n_private"),
    )
