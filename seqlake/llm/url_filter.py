"""URL filter by a weighted vocabulary (7).

An Aho-Corasick automaton counts strict and soft terms whose neighbours are no letters or digits;
one strict hit or `soft_limit` distinct soft ones reject a URL. Host rules come first.

Null or empty URLs, or such without "://": host and path are empty, no rule fits; terms are still
sought in the whole URL. Repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Strict terms, soft terms, host rules.
STRICT = ("casino", "malware", "phishing", "porn", "spam", "viagra", "warez", "xxx")
SOFT = ("adult", "bonus", "cheap", "deals", "free", "loan", "pills", "poker", "win")
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def term_counter(strict: tuple[str, ...], soft: tuple[str, ...]):
    """A pandas UDF: strict hits and distinct soft terms of each URL."""

    @F.pandas_udf("strict int, soft int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for kind, words in ((0, soft), (1, strict)):
            for w in words:
                machine.add_word(w, (kind, w))
        machine.make_automaton()
        word = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        fold = str.maketrans(UPPER, LOWER)

        def one(url: str | None) -> tuple[int, int]:
            if not url:
                return 0, 0
            s, hits, found = url.translate(fold), 0, set()
            for end, (kind, w) in machine.iter(s):
                if s[end + 1 : end + 2] in word or (end >= len(w) and s[end - len(w)] in word):
                    continue
                if kind:
                    hits += 1
                else:
                    found.add(w)
            return hits, len(found)

        for urls in batches:
            yield pd.DataFrame([one(u) for u in urls], columns=["strict", "soft"])

    return count


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def verdicts(pages: DataFrame, *, url: str = "url", strict=STRICT, soft=SOFT, rules=RULES, soft_limit: int = 2) -> DataFrame:
    """pages with host, path, rule, verdict, strict_hits and soft_terms."""
    df = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url)), "_t": term_counter(tuple(strict), tuple(soft))(F.col(url))})
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith("/" + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    own = F.when((F.col("_t.strict") >= 1) | (F.col("_t.soft") >= soft_limit), "block").otherwise("allow")
    df = df.withColumn("rule", rule if rule is not None else F.lit(None).cast("string"))
    return df.withColumns({"verdict": F.coalesce(verdict, own) if verdict is not None else own, "strict_hits": F.col("_t.strict"), "soft_terms": F.col("_t.soft")}).drop("_t")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return verdicts(pages).select("page_id", "host", "path", "rule", "verdict", F.col("strict_hits").cast("long"), F.col("soft_terms").cast("long"))


def sql() -> str:
    hit = lambda w: f"regexp_matches(lu, '(^|[^a-z0-9]){w}([^a-z0-9]|$)')::BIGINT"
    count = lambda w: f"len(regexp_extract_all(regexp_replace(lu, '([^a-z0-9])', '\\1\\1', 'g'), '(?:^|[^a-z0-9]){w}(?:[^a-z0-9]|$)'))"
    cases = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')", w, t) for w, t in sorted(RULES, key=lambda r: -len(r[1])) for h, _, p in [t.partition("/")]]
    return f"""
WITH u AS (SELECT page_id, url, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS lu FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path,
  CAST({' + '.join(map(count, STRICT))} AS BIGINT) AS strict_hits, {' + '.join(map(hit, SOFT))} AS soft_terms FROM u)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {c} THEN '{t}'" for c, _, t in cases)} END AS rule,
  CASE {' '.join(f"WHEN {c} THEN '{w}'" for c, w, _ in cases)} WHEN strict_hits >= 1 OR soft_terms >= 2 THEN 'block' ELSE 'allow' END AS verdict,
  strict_hits, soft_terms FROM p"""
