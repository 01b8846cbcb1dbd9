"""The operators on small tables, against brute force; nulls, empty and repeated rows, clashing columns."""

import itertools
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqlake.llm import decontaminate, licences, line_templates, minhash, mixing, queries, sanitise, token_store, topk, toxicity, url_filter
from seqlake.llm.common import components

ODD = [(None, "null id"), (7, None), (8, ""), (9, " \n "), (10, "twice here"), (10, "twice here"), (11, "x" * 30_000), (12, "word " * 3000)]
SCHEMA = "doc_id long, text string, key string, label string, n int, h long, line string, items string, score string, rate string"
EXTRA = ("k", "l", 3, 4, "ln", "it", "s", "r")


def frame(spark, rows):
    """Documents with columns whose names operators might use."""
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


VOCAB = [f"w{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


@pytest.mark.parametrize("name", ["op3_topk_search", "op7_url_filter"])
def test_same_as_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    got, want = queries.queries()[name](spark, small), con.sql(queries.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(cols).collect()))) == sorted(map(str, want.select(*cols).fetchall()))


def test_urls(spark):
    rows = [None, "", "no scheme casino", "HTTP://A.Example.NET/en/x?q", "https://x.net", "https://b.example.com/de/1", "https://y.org/fr/z#t", "http://cheap-pills.io/", "http://cheap.io/cheap", "http://freedom.io/xfree", "http://spam-farm.io/", "http://spammer.io/"]
    got = [tuple(r) for r in url_filter.verdicts(spark.createDataFrame([(u, i) for i, u in enumerate(rows)], "url string, i int")).orderBy("i").select("host", "path", "rule", "verdict").collect()]
    assert got[0] == got[1] == ("", "", None, "allow") and got[2] == ("", "", None, "block")
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[4] == ("x.net", "", None, "allow")
    assert [g[3] for g in got[5:]] == ["block", "allow", "block", "allow", "allow", "block", "allow"]


def test_top_k_ties_nulls_and_shapes(spark):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(150)] + [(200 + i, [0.5] * 6) for i in range(60)]
    rows += [(500, [5e6, 1.0]), (501, [-4.2e6] * 6), (520, [1e7, -1e7, 0.0, 3.3]), (540, [2.0**29, 1.0, 0.0, 0.0, 2.0**26]), (541, [-(2.0**28), 0.5])]  # wide components
    bad = [(401, None), (402, [1.0, None]), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (None, [1.0] * 6), (405, [float("-inf")] * 6), (406, [1e308] * 6)]
    df = spark.createDataFrame([*rows, rows[40], (420, [0.25])] + bad, "vec_id long, embedding array<double>")
    v = topk.integer_vectors(df, "vec_id", "embedding", 64)
    got = {}
    for x in topk.top_k(v, v.filter("id % 20 = 0"), k=20, pack=32, chunk=4, block=8).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    vecs = [(i, [int(float(e) * 64 // 1) for e in x]) for i, x in [*rows, rows[40], (420, [0.25])]]
    for q, x in {i: x for i, x in vecs if i % 20 == 0}.items():
        s = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y)))), i) for i, y in vecs if i != q)[:20]
        assert sorted(got[q]) == [(k, i, -m) for k, (m, i) in enumerate(s, 1)]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_tokens_whole_texts(spark):
    import numpy as np
    import public_tokenizers
    import zlib
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [*ODD, *((20 + i, prose(50 * i, i)) for i in range(8))]
    lib, want, start = Tokenizer.from_file(path), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    store = token_store.write_tokens(frame(spark, rows), path, block=300, lanes=8, every=5)
    got = token_store.read_tokens(spark.newSession(), store).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()  # by its path alone
    assert [tuple(r) for r in got] == want
    assert token_store.read_tokens(spark, token_store.write_tokens(frame(spark, []), path)).count() == 0


def test_tokens_of_another_tokenizer(spark):
    import numpy as np
    import public_tokenizers
    import zlib
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not token_store.by_chunks(path) and token_store.by_chunks(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(1, "Two  Words, and\nMORE"), (2, None), (3, "it's ñ \u4e2d " * 50)]
    lib = Tokenizer.from_file(path)
    got = token_store.read_tokens(spark, token_store.write_tokens(frame(spark, rows), path, end_id=50256)).orderBy("doc_id").collect()
    for x, (_, t) in zip(got, rows, strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 50256]
        assert (x.n_tokens, x.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def similar(a, b):
    """Edit similarity of words at 0.8 or more."""
    x, y = a.lower().split(), b.lower().split()
    p = list(range(len(y) + 1))
    for i, u in enumerate(x, 1):
        c = [i]
        for j, v in enumerate(y, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (u != v)))
        p = c
    return p[-1] <= 0.2 * max(len(x), len(y))


def test_near_copies(spark):
    r = random.Random(11)
    rows = list(ODD)
    for g in range(8):
        base = prose(80, g).split()
        for k in range(g % 4 + 1):
            own = list(base)
            for _ in range(k):
                own[r.randrange(len(own))] = f"new{r.random()}"
            rows.append((100 + 10 * g + k, " ".join(own)))
    rows.append((300, rows[-1][1].upper()))
    got = minhash.with_classes(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    of = {x.doc_id: x.class_id for x in got}
    ids = [(i, t) for i, t in rows if i is not None and t and t.split()]
    link = {i: {i} for i, _ in ids}
    for (i, a), (j, b) in itertools.combinations(ids, 2):
        if len(a) < 5000 and len(b) < 5000 and similar(a, b):
            for x in (m := link[i] | link[j]):
                link[x] = m
    assert {i: of[i] for i, _ in ids} == {i: min(m) for i, m in link.items()}
    assert (of[7], of[8], of[9]) == (7, 8, 9)
    assert {x.class_size for x in got if x.doc_id == 10} == {2}
    kept = minhash.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    left = sorted(str(x.doc_id) for x in kept.collect())
    assert left == sorted(str(i) for i in {*(min(m) for m in link.values()), None, 7, 8, 9})
    assert minhash.with_classes(frame(spark, [])).count() == 0


def test_near_copies_at_the_threshold_and_in_order_only(spark):
    """200 words with 36 of them replaced; two halves changed about; a family with common text under the threshold."""
    r, rows = random.Random(3), []
    for g in range(120):
        base = prose(200, 4000 + g).split()
        other = list(base)
        for at in r.sample(range(200), 36):
            other[at] = f"new{r.random()}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    turned = prose(100, 1).split()
    rows += [(1000, " ".join(turned)), (1001, " ".join(turned[50:] + turned[:50]))]
    common = prose(140, 2)
    family = [f"{common} {prose(60, 6000 + g)}" for g in range(150)]  # 0.7 alike
    rows += [(2000 + 2 * g, t) for g, t in enumerate(family)] + [(2001 + 2 * g, t + " and more") for g, t in enumerate(family)]
    of = {x.doc_id: x.class_id for x in minhash.with_classes(frame(spark, rows)).collect()}
    assert sum(of[2 * g] == of[2 * g + 1] for g in range(120)) >= 0.9 * 120
    assert of[1000] != of[1001]
    assert all(of[2000 + 2 * g] == of[2001 + 2 * g] == 2000 + 2 * g for g in range(150))


def test_every_alike_pair_of_a_bucket_is_linked(spark):
    """A family with common text, each text with a copy at the threshold: whichever share a signature are compared."""
    r, rows = random.Random(5), []
    common = prose(140, 2)
    for g in range(150):
        text = f"{common} {prose(60, 7000 + g)}".split()
        other = list(text)
        for at in r.sample(range(200), 38):
            other[at] = f"new{r.random()}"
        rows += [(2 * g, " ".join(text)), (2 * g + 1, " ".join(other))]
    rows += [(1000, "Few Words"), (1001, "few  words"), (1002, "few other words")]
    met = []
    for _, t in rows:
        _, w = minhash.word_codes(pa.array([t]))
        met.append(set(minhash.order_minhash(minhash.labelled(minhash.shingles(w, minhash.K)), minhash.SKETCHES, minhash.LEAST).tolist()))
    of = {x.doc_id: x.class_id for x in minhash.with_classes(frame(spark, rows)).collect()}
    want = [2 * g for g in range(150) if met[2 * g] & met[2 * g + 1]]
    assert len(want) > 100
    assert [g for g in want if of[g] != of[g + 1]] == []
    assert of[1000] == of[1001] != of[1002]


def test_seldom_pieces_miss_no_alike_pair(spark):
    r, rows = random.Random(6), []
    base = prose(60, 3).split()
    for i in range(700):  # more than one block
        own = list(base[: r.choice([1, 4, 30, 60, 60])])
        for _ in range(r.randrange(1 + len(own) // 4)):
            at = r.randrange(len(own))
            own[at : at + r.randrange(3)] = [f"w{r.randrange(30)}"] * r.randrange(1, 3)
        rows.append((i, i, " ".join(own)))
    texts = spark.createDataFrame(rows, "nid long, label long, text string")
    got = minhash.pairs_of_seldom_pieces(texts, 0.8).collect()
    assert len({(x.a, x.b) for x in got}) == len(got)
    some = r.sample(list(itertools.combinations(range(700), 2)), 1500)
    found = {(x.a, x.b) for x in got}
    want = [(a, b) for a, b in some if similar(rows[a][2], rows[b][2])]
    assert len(want) > 50 and not [p for p in want if p not in found]


def test_near_copies_ask_few_pairs(spark, monkeypatch):
    """Texts with a common passage share many buckets with many representatives: each text asks one of them, however many it meets."""
    common, asked = prose(60, 2), []
    rows = [(g, f"{common} {prose(60, 8000 + g)}") for g in range(200)]
    rows += [(1000 + g, rows[g][1] + " and more") for g in range(200)]
    plausible = minhash.plausible
    monkeypatch.setattr(minhash, "plausible", lambda pairs, *rest: asked.append(pairs.count()) or plausible(pairs, *rest))
    of = {x.doc_id: x.class_id for x in minhash.with_classes(frame(spark, rows)).collect()}
    assert all(of[g] == of[1000 + g] == g for g in range(200))
    assert sum(asked) <= len(rows)


def test_seldom_pieces_make_rows_of_likely_pairs_only(spark):
    """Long texts that share most words, but too few: what counts of words in few bins let through makes no rows."""
    r = random.Random(8)
    some = [f"w{i}" for i in range(4000)]
    common = r.choices(some, k=1160)
    texts = [[*common, *r.choices(some, k=440)] for _ in range(60)]
    got = minhash.pairs_of_seldom_pieces(spark.createDataFrame([(i, i, " ".join(t)) for i, t in enumerate(texts)], "nid long, label long, text string"), 0.8).count()
    counts = [Counter(t) for t in texts]
    may = sum((counts[a] - counts[b]).total() <= 320 for a, b in itertools.combinations(range(60), 2))
    assert may <= got <= 1.3 * may + 20


def test_large_class_is_not_laid_beside_others_piece_by_piece(spark, monkeypatch):
    """A class of near copies shares many pieces with a few texts of other classes: its texts move once, not once a piece."""
    r, rows = random.Random(11), []
    base = prose(60, 12).split()
    for i in range(660):
        own = list(base)
        for _ in range(r.randrange(12) if i < 600 else 14):
            own[r.randrange(60)] = f"new{r.random()}"
        rows.append((i, 0 if i < 400 else 1 if i < 600 else i, " ".join(own)))
    texts = spark.createDataFrame(rows, "nid long, label long, text string")
    got = [(x.a, x.b) for x in minhash.pairs_of_seldom_pieces(texts, 0.8).collect()]
    assert len(set(got)) == len(got)
    others = [(i, j) for i, j in itertools.combinations(range(660), 2) if rows[i][1] != rows[j][1]]
    some = r.sample([p for p in others if p[1] < 600], 700) + r.sample([p for p in others if p[1] >= 600], 700)
    want = [(a, b) for a, b in some if similar(rows[a][2], rows[b][2])]
    assert len(want) > 50 and not [p for p in want if p not in set(got)]

    def moved(similarity):
        def run(batches):
            for b in batches:
                n = [sum(len(b.column(c)[i]) for c in ("xs", "ys")) for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())] * 3, ["a", "b", "c"])

        return run

    monkeypatch.setattr(minhash, "_beside", moved)
    few = texts.filter("label <> 1 and nid < 610")
    assert sum(x.a for x in minhash.pairs_of_seldom_pieces(few, 0.8).collect()) <= 2 * few.count()


def test_components_on_the_driver_and_by_rounds(spark):
    r = random.Random(9)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(190)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    df = spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long")
    here, there = (dict(map(tuple, components(df, most_local=n).collect())) for n in (10**6, 0))
    assert here == there and here[1040] == 1000


def test_benchmark_passages(spark):
    items = [(1, prose(30, 901)), (2, prose(20, 902)), (3, "just four words here"), (4, None), (5, "")]
    words = items[0][1].split()
    changed = list(words)
    changed[5], changed[20] = "other", "thing"
    rows = [*ODD, (50, prose(40, 1) + " " + " ".join(words).upper() + "!"), (51, " ".join(changed)), (52, prose(60, 2)), (53, "so JUST four, words here."), (54, " ".join(words[:10]) + " " + prose(20, 3)), (55, " ".join(words[8:24])), (56, items[1][1] + "\n" + items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x["items"] for x in decontaminate.contamination(frame(spark, rows), bench).collect()}
    assert {i: v for i, v in got.items() if v} == {50: [1], 51: [1], 53: [3], 55: [1], 56: [1, 2]}
    joined = {x.doc_id: x["items"] for x in decontaminate.contamination(frame(spark, rows), bench, most_broadcast=0).collect()}
    assert joined == got
    kept = decontaminate.decontaminated(frame(spark, rows), bench)
    assert kept.columns == frame(spark, []).columns and kept.count() == len(rows) - 5
    assert decontaminate.decontaminated(frame(spark, rows), bench.limit(0)).count() == len(rows)


def test_benchmark_windows_like_brute_force(spark):
    r = random.Random(7)
    items = [(k, prose(25, 500 + k)) for k in range(6)]
    rows = []
    for i in range(60):
        w = items[i % 6][1].split()[r.randrange(8) :][: r.choice((12, 14, 17))]
        for _ in range(r.choice((0, 0, 1, 2, 5))):
            w[r.randrange(len(w))] = "other"
        rows.append((i, " ".join([prose(10, i), *w, prose(10, 99 + i)])))
    got = {x.doc_id: set(x["items"]) for x in decontaminate.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    sure = {}
    for i, t in rows:
        d = t.split()
        for k, x in items:
            w = x.split()
            for a in range(len(d) - 12):
                for b in range(len(w) - 12):
                    miss = sum(u != v for u, v in zip(d[a : a + 13], w[b : b + 13]))
                    if miss <= 2:
                        sure.setdefault(i, {}).setdefault(k, 9)
                        sure[i][k] = min(sure[i][k], miss)
    for i, _ in rows:
        assert got[i] <= set(sure.get(i, {}))  # nothing but what the windows hold
        assert {k for k, m in sure.get(i, {}).items() if m == 0} <= got[i]  # and every exact one


def test_benchmark_passages_with_every_placement_of_substitutions(spark):
    items = [(k, prose(n, 700 + k)) for k, n in enumerate((25, 7, 9, 10, 12, 13))]
    rows, due = [], {}
    for k, x in items:
        w = x.split()
        start, size = (6, 13) if len(w) > 13 else (0, len(w))
        for n in range(size * 2 // 13 + 1):
            for at in itertools.combinations(range(size), n):
                bare = ["other" if i in at else t for i, t in enumerate(w[start : start + size])]
                for text in (bare, [*prose(3, 5).split(), *bare, *prose(3, 6).split()]):
                    due[len(rows)] = [k]
                    rows.append((len(rows), " ".join(text)))
    over = items[1][1].split()
    rows.append((len(rows), " ".join(["other", "other", *over[2:]])))  # more than an item of 7 words allows
    got = {x.doc_id: x["items"] for x in decontaminate.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {**due, len(rows) - 1: []}


def test_benchmark_of_one_repeated_word_and_odd_tables(spark):
    items = [(1, "no " * 40), (2, "no " * 12 + "yes"), (3, prose(20, 31)), (3, prose(20, 31)), (None, None)]
    rows = [(1, "no " * 3000), (2, "no " * 13), (3, "no " * 11 + "other yes"), (4, "no " * 10 + prose(9, 4)), (5, prose(20, 31)), (5, prose(20, 31)), (None, None), (6, "")]
    bench = spark.createDataFrame([(*x, 0.5, "h") for x in items], "item_id long, text string, n double, tk string")
    got = decontaminate.contamination(frame(spark, rows), bench).collect()
    assert len(got) == len(rows)
    assert {(x.doc_id, tuple(x["items"])) for x in got} == {(1, (1, 2)), (2, (1, 2)), (3, (1, 2)), (4, ()), (5, (3,)), (None, ()), (6, ())}
    assert decontaminate.contamination(frame(spark, []), bench).count() == 0


def test_toxicity(spark):
    r = random.Random(2)
    bad, rows, labels = ("vilest", "grubbo", "mudhead"), list(ODD), []
    for i in range(400):
        toxic = i % 4 == 0
        w = prose(40, i).split()
        if toxic:
            w[r.randrange(40)] = r.choice(bad)
        rows.append((1000 + i, " ".join(w)))
        labels.append((1000 + i, int(toxic)))
    rows += [(5000, prose(30, 1) + " v i l e s t"), (5001, "gru880 " + prose(30, 2)), (5002, prose(30, 3))]
    labels += [(None, 1), (1002, None), (99, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.scored(frame(spark, rows), lab, keep=toxicity.remainder(F.col("doc_id")) != 2, carry=["doc_id"])
    got = {x.doc_id: x.score for x in out.collect()}
    assert all((got[i] >= 0.3) == bool(t) for i, t in labels if i and i >= 1000 and t is not None)
    assert got[5000] >= 0.3 and got[5001] >= 0.3 and got[5002] < 0.3
    assert all(0 <= s < 0.3 for i, s in got.items() if i is None or i < 100)
    assert toxicity.reject_toxic(frame(spark, rows), lab).columns == frame(spark, []).columns
    none = toxicity.scored(frame(spark, ODD), lab.limit(0), keep=F.lit(True)).collect()
    assert len(none) == len(ODD)


def test_personal_data(spark):
    mail = "ann.lee@mail.example.com"
    rows = [*ODD, *((20 + i, f"the chess master writes from {mail} today {prose(5, i)}") for i in range(4)), *((40 + i, prose(20, i) + " today the") for i in range(12)), (60, "once bob@x.example.org only")]
    got = {x.doc_id: x for x in sanitise.spans(frame(spark, rows)).collect()}
    text = dict(rows)
    found = {text[20][t.s : t.e] for t in got[20].terms}
    assert {"chess", "master", "writes"} <= found and "today" not in found and "the" not in found
    assert [(b.k, text[20][b.s : b.e]) for b in got[20].base] == [(0, mail)]
    assert got[60].base and not got[60].terms and not got[7].base and not got[None].base
    by_join = {x.doc_id: x for x in sanitise.spans(frame(spark, rows), most_told=0).collect()}
    assert by_join == got
    assert sanitise.spans(frame(spark, [])).count() == 0
    clean = {x.doc_id: x.text for x in sanitise.sanitised(frame(spark, rows)).collect()}
    assert mail not in clean[20] and "[EMAIL]" in clean[20] and "chess" not in clean[20] and clean[60] == "once [EMAIL] only" and clean[7] is None


def test_disclosure_like_brute_force(spark):
    import math

    r, rows = random.Random(4), list(ODD[1:])
    people = {f"{n}@mail{k}.example.com": [f"zed{n}", f"often{n}", r.choice(VOCAB)] for k, n in enumerate(("ann", "bob", "cy", "dee", "ed"))}
    for i in range(150):
        words = prose(30, 100 + i).split()
        if i % 3 == 0:
            who = r.choice(list(people))
            at = r.randrange(len(words))
            words[at:at] = [*(w.upper() if r.random() < 0.5 else w for w in people[who]), who] if r.random() < 0.8 else [who]
        if i % 3 == 1:
            words.append(r.choice(("oftenann", "oftenbob", "oftency")))
        if i % 50 == 7:
            words.append("9233A8ECF7C5B09FE5949719B6B82BC439E9329B aaaaaaaaaaaaaaaaaaaaaaaaaaaaa1")
        rows.append((100 + i, " ".join(words)))
    rows.append((900, rows[-1][1]))
    n, c_e, c_t, c_et = len(rows), {}, {}, {}
    for _, t in rows:
        t = t or ""
        for w in set(re.findall("[a-z]+", t.lower())):
            c_t[w] = c_t.get(w, 0) + 1
        for e in {m.group() for m in re.finditer(r"\w+@\S+", t)}:
            c_e[e] = c_e.get(e, 0) + 1
            i = t.index(e)
            near = t[:i].split()[-8:] + t[i + len(e) :].split()[:8]
            for w in {x.lower() for x in near if x.isalpha() and len(x) >= 3}:
                c_et[e, w] = c_et.get((e, w), 0) + 1
    told = {}
    for (e, w), c in c_et.items():
        if c >= 2 and c_e[e] >= 2:
            share = math.log(n * c / (c_e[e] * max(c_t[w], c))) / math.log(n / c_e[e])
            if share >= 0.5:
                told[w] = told.get(w, False) or share >= 0.7
    assert told and not all(told.values())
    for x in sanitise.spans(frame(spark, rows), disclosure=0.5, removal=0.7).collect():
        t = dict(rows)[x.doc_id] or ""
        want = [(m.start(), m.end(), told[m.group().lower()]) for m in re.finditer(r"[^\W\d_]{3,}", t) if m.group().lower() in told and not any(b.s < m.end() and m.start() < b.e for b in x.base)]
        assert [(y.s, y.e, y.removed) for y in x.terms] == want
        assert [t[y.s : y.e] for y in x.secrets] == re.findall("9233A8E\\w+", t)


def test_licences(spark):
    rows = [*ODD, (20, "intro\nReleased under the MIT License.\nmore"), (21, "Licensed under the Apache License, Version 2.0."), (22, "a permission slip for the school trip on monday"), (23, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.")]
    rows += [(100 + i, f"the driver had no licence {prose(6, i)} all rights") for i in range(40)]
    df = frame(spark, rows)
    found = {}
    for x in licences.licence_paragraphs(df, steps=12).collect():
        found.setdefault(x.key, set()).add(x.family)
    keys = {x.doc_id: x.k for x in df.select("doc_id", licences.row_key(F.col("doc_id"), F.col("text")).alias("k")).collect()}
    assert found[keys[20]] == {"mit"} and found[keys[21]] == {"apache"} and keys[22] not in found and found[keys[23]] == {"gpl", "cc-by-nc"}
    assert keys[8] not in found and found[keys[100]] == {"unknown"}
    gate = set(licences.gate_words())
    assert all(len(gate & set(re.split(r"[^\w.]+|\.(?=\s|$)", t.lower()))) >= 2 for ts in licences.TEMPLATES.values() for t in ts)
    assert licences.licence_paragraphs(frame(spark, [])).count() == 0


WRAPPED = """Some tool
Permission is hereby granted, free of charge, to any person obtaining a
copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software.

Distributed under the terms of the GNU GPL v3.
Available under CC BY-SA 4.0."""


def test_wrapped_notices_and_short_ones(spark):
    rows = [(1, WRAPPED), (1, WRAPPED), (2, "The software is provided as is, without warranty of any kind, express or implied."), (3, None), (4, "\n\n")]
    rows += [(100 + i, f"the binary source of {prose(6, i)} copyright") for i in range(30)]
    df = frame(spark, rows)
    got = licences.licence_paragraphs(df).collect()
    key = {x.doc_id: x.k for x in df.select("doc_id", licences.row_key(F.col("doc_id"), F.col("text")).alias("k")).collect()}
    one = sorted((x.no, x.family) for x in got if x.key == key[1])
    assert one == [(1, "mit"), (7, "gpl"), (8, "cc-by")]
    assert [x.family for x in got if x.key == key[2]] == ["mit"]
    assert {x.family for x in got if x.key in {key[100 + i] for i in range(30)}} == {"unknown"}


def test_licence_training_like_plain_gradient_descent(spark):
    import numpy as np

    plain = lambda t: [w for w in re.split(r"[^\w.]+|\.(?=\s|$)", t.lower().replace("_", " ")) if w]
    grams = lambda ws: list(dict.fromkeys([*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))]))
    other = [prose(9, i) + " software license" for i in range(12)]
    rows = []
    for f, ts in licences.TEMPLATES.items():
        for t in ts:
            ws = plain(t)
            half = -(-len(ws) // 2)
            rows += [(f, ws), (f, ws), (f, ws[:half]), (f, ws[half - 1 :][: half + 1])]
    vocab = {g: k for k, g in enumerate(sorted({"*"} | {g for _, ws in rows for g in grams(ws)}))}
    rows += [("unknown", plain(t)) for t in other]
    x = np.zeros((len(rows), len(vocab)))
    for i, (_, ws) in enumerate(rows):
        own = [*grams(ws), "*"]
        for g in own:
            if g in vocab:
                x[i, vocab[g]] = 1 / np.sqrt(len(own))
    y = np.array([licences.CLASSES.index(f) for f, _ in rows])
    share = 1 / np.bincount(y, minlength=len(licences.CLASSES))[y] / len(licences.CLASSES)
    w = np.zeros((len(vocab), len(licences.CLASSES)))
    for _ in range(4):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        w = w * (1 - licences.RATE * licences.DECAY) - licences.RATE * len(licences.CLASSES) * x.T @ (p * share[:, None])
    unknown = spark.createDataFrame([(plain(t),) for t in other], "ws array<string>")
    got = {r.f: r.w for r in licences.train(spark, unknown, steps=4).collect()}
    assert set(got) == set(vocab)
    assert max(np.abs(np.array(got[g]) - w[k]).max() for g, k in vocab.items()) < 1e-9


def test_licence_model_and_threshold_take_all_paragraphs(spark, monkeypatch):
    rows = [(i, f"the binary source copyright word{i}") for i in range(2600)]
    seen, train = [], licences.train
    monkeypatch.setattr(licences, "train", lambda spark, unknown, **how: (seen.append(unknown.count()), train(spark, unknown, **how))[1])
    got = licences.licence_paragraphs(frame(spark, rows), steps=1)
    assert {x.family for x in got.select("family").distinct().collect()} == {"unknown"}
    assert 1150 < seen[0] < 1450  # half of all; the others set the threshold


def brute_templates(rows, min_docs=4):
    """Masked lines to drop, from the definition: lines of a leaf, the places that each choice of blocks leaves open."""
    leaves = {}
    for r in set(rows):
        for s in (r[1] or "").split("\n"):
            m = tuple("<*>" if any(c.isdigit() for c in t) else t for t in s.split())
            if m:
                leaves.setdefault((len(m), m[:3]), {}).setdefault(m, set()).add(r)
    drop = set()
    for (n, _), kinds in leaves.items():
        drop |= {m for m, own in kinds.items() if len(own) >= min_docs}
        blocks = min(n - 3, 8)
        if n < 6:
            continue
        cut = [3 + (n - 3) * k // blocks for k in range(blocks + 1)]
        of = {p: next(k for k in range(blocks) if cut[k] <= p < cut[k + 1]) for p in range(3, n)}
        for w in (1, 2, 3):
            for wild in itertools.combinations(range(blocks), w):
                gone = {p for p in range(3, n) if of[p] in wild}
                if len(gone) * 10 > n * 3:
                    continue
                groups = {}
                for m in kinds:
                    groups.setdefault(tuple(None if p in gone else t for p, t in enumerate(m)), []).append(m)
                for ms in groups.values():
                    if len(ms) > 1 and len(set().union(*(kinds[m] for m in ms))) >= min_docs:
                        drop.update(ms)
    return {" ".join(m) for m in drop}


def test_line_templates(spark):
    rows = [*ODD, *((20 + i, f"{prose(8, i)}\nseen on day {i} by the guard of gate\n\n{prose(6, 50 + i)}") for i in range(5)), *((40 + i, f"same start of line then one word {VOCAB[i]}") for i in range(4)), (60, "a b\nseen on day 9 by the guard of gate")]
    drop = brute_templates(rows)
    out = line_templates.without_templates(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {x.doc_id: x for x in out}
    for i, t in rows:
        if t is None:
            assert by[i].text is None and by[i].n_lines == 0
            continue
        gone = [" ".join(line_templates.masked(s)) in drop for s in t.split("\n")]
        assert by[i].text == "\n".join(s for s, g in zip(t.split("\n"), gone) if not g) and by[i].n_dropped == sum(gone)
    assert by[20].n_dropped == 1 and by[40].n_dropped == 1 and by[60].text == "a b"
    assert line_templates.without_templates(frame(spark, [])).count() == 0


def test_templates_of_a_large_leaf_are_all_found(spark):
    """One leaf of 6,200 lines: 300 templates of four documents each, with one and with two variable words, among other lines."""
    r = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bcdfghjk" for b in ("am", "en", "ir", "ot") for c in "lmnrst"]
    rows = []
    for k in range(300):
        fixed = [r.choice(words) for _ in range(7)]
        for _ in range(4):
            own = list(fixed)
            for at in (2,) if k % 2 else (1, 5):
                own[at] = r.choice(words)
            rows.append("all of the " + " ".join(own))
    due = set(rows)
    rows += ["all of the " + " ".join(r.choice(words) for _ in range(7)) for _ in range(5000)]
    rows = list(enumerate(rows))
    drop = brute_templates(rows)
    assert due <= drop and len(drop) < 1300
    for parts in (1, 7):
        out = line_templates.without_templates(frame(spark, rows).repartition(parts)).filter("n_dropped > 0").collect()
        assert {dict(rows)[x.doc_id] for x in out} == drop


def test_mixing_meets_targets(spark):
    rows, labels = list(ODD), []
    for i in range(300):
        noisy = i % 3 == 0
        rows.append((1000 + i, prose(40 + i % 7, i) if not noisy else prose(40, i).replace(" ", "### ")))
        labels.append((1000 + i, 0 if noisy else 1))
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int")
    mix = mixing.mixed(frame(spark, rows), lab, weights={"0": 0.2, "1": 0.8}, strict=True)
    domains, got = mix.domains, mix.rows.collect()
    assert domains == ["0", "1"] and len(got) == len(rows)
    n = sum(x.n_tokens for x in got)
    assert n == sum(len(re.findall(r"[^ \n\t\r]+", t or "")) for _, t in rows)
    for k, share in enumerate((0.2, 0.8)):
        assert abs(sum(x.rate * x.n_tokens * x.posteriors[k] for x in got) - share * n) <= 0.01 * n
    assert all(x.rate >= 0 and x.copies in (int(x.rate), int(x.rate) + 1) for x in got)
    same = [(x.rate, x.copies) for x in got if x.doc_id == 10]
    assert same[0] == same[1]
    again = mixing.repeated(frame(spark, rows), lab, weights={"0": 0.4, "1": 0.6}, low=1.0, budget=1.2)
    assert {x.doc_id for x in again.select("doc_id").collect()} == {i for i, _ in rows}
    one = mixing.mixed(frame(spark, rows), lab.limit(0))
    assert one.domains == ["all"] and {round(x.rate, 6) for x in one.rows.collect()} == {1.0}
    assert mixing.mixed(frame(spark, []), lab).rows.count() == 0
    with pytest.raises(ValueError):  # beyond what rates up to 4 can reach
        mixing.mixed(frame(spark, rows), lab, budget=9.0, strict=True)
    with pytest.warns(UserWarning):
        far = mixing.mixed(frame(spark, rows), lab, budget=9.0)
    assert far.residual > 0.5 and max(x.rate for x in far.rows.collect()) == 4.0


def test_mixing_like_brute_force(spark):
    """Posteriors from the model's terms and least squares by plain gradient descent, over three domains."""
    import math

    import numpy as np
    import xxhash

    pool = {d: [f"{d}{x}{y}" for x in "abcdef" for y in "mnop"] for d in "uvw"}
    r, rows, labels = random.Random(8), [(None, None), (1, ""), (2, "u u\t\nu")], []
    for i in range(360):
        d = "uvw"[i % 3]
        mixed = [r.choice(pool[d if r.random() < 0.8 else r.choice("uvw")]) for _ in range(r.randrange(1, 60))]
        rows.append((10 + i, r.choice((" ", "  ", "\n")).join(mixed)))
        labels.append((10 + i, d))
    lab = spark.createDataFrame(labels, "doc_id long, kind string")
    docs = frame(spark, rows)
    model = mixing.fitted(docs, lab, domain="kind", doc_id="doc_id", text="text")
    mix = mixing.mixed(docs, lab, domain="kind", weights={"u": 0.5, "v": 0.3, "w": 0.2}, high=3.0, strict=True)
    got = {x.doc_id: x for x in mix.rows.collect()}
    signed = lambda h: h - (1 << 64) * (h >> 63)

    def h(*parts):
        seed = 42
        for x in parts:
            seed = xxhash.xxh64_intdigest(x.encode(), seed)
        return signed(seed) % mixing.BUCKETS

    def posterior(text):
        ws = [w for w in re.split(r"[ \n\t\r]", text or "") if w]
        x = [sum(own[h(w)] + own[h("end", w[-2:])] for w in ws) / max(1, len(ws)) / 100 for own in model.weights] + [1.0, math.log1p(len(ws))]
        e = [1.0, *(math.exp(sum(a * b for a, b in zip(x, t))) for t in model.terms)]
        p = [round(v / sum(e) * 1000) / 1000 for v in e[:-1]]
        return len(ws), [*p, 1 - sum(p)]

    n, p = zip(*(posterior(t) for _, t in rows))
    for (i, _), size, own in zip(rows, n, p):
        assert got[i].n_tokens == size and max(abs(a - b) for a, b in zip(got[i].posteriors, own)) <= 0.0011
    assert sum(max(range(3), key=lambda k: got[i].posteriors[k]) == "uvw".index(d) for i, d in labels) > 330
    n, p = np.array(n, float), np.array([got[i].posteriors for i, _ in rows])
    want, rate = np.array([0.5, 0.3, 0.2]) * n.sum(), np.ones(len(n))
    for _ in range(4000):
        rate = np.clip(rate - p @ ((rate * n) @ p - want) / (n @ (p * p).sum(1)), 0.0, 3.0)
    assert np.abs((rate * n) @ p - want).max() <= 1e-3 * n.sum()
    assert np.abs(np.array([got[i].rate for i, _ in rows]) @ (n[:, None] * p) - want).max() <= 1e-3 * n.sum()
    assert all(0 <= x.rate <= 3 for x in got.values())
