"""Toxicity of deobfuscated text (2).

Noisy channel: a word that someone disguised (leetspeak, spaced-out letters, repeated letters) is read
back by a Viterbi decoder over a lattice of what each character may stand for, under a character
4-gram model counted over every text of the corpus. A word of plain letters has one path, itself, so only
spans that hold such signs are decoded. The restored text is scored by a list of word features (whole
words and their beginnings and ends) learnt from labelled rows: features are taken greedily by the
labelled-toxic texts that they explain and that no feature before explained, so a feature that merely
goes along with copies of a toxic text is not learnt.

The score is 1 - prod(1 - precision) over the features found, or the rate of toxic texts without any.
Null and empty texts have no feature. Rows that repeat score alike. Labels of null ids or null marks,
or for unknown rows, are ignored; of an id or a text labelled twice, toxic wins. Without usable labels all scores are 0.
Only the text enters a score.
"""

from __future__ import annotations

import heapq
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, text_key, written

#: What signs may stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "€": "e", "+": "t"}
MOST_SPAN = 60  # a longer disguise or word is not remembered
REMEMBERED = 100_000  # disguises or words that a task remembers at once
TRAIN_ROWS = 20_000  # bound of the labelled sample that features are learnt from
SINGLE = -2.5  # log-probability that a doubled letter stands for one
MIN_TEXTS = 3  # texts that a feature must newly explain
MIN_PRECISION = 0.9
BOUND = 27  # the code of a word's edge
BASE = 28
DEEP = BASE**4


def letter_codes():
    """Code of each character below 0x250: 0..25 for a..z without accents, 26 for other letters, 27 else."""
    import numpy as np

    out = np.full(0x250, BOUND, "i8")
    for c in range(0x250):
        s = unicodedata.normalize("NFD", chr(c).lower())[:1]
        out[c] = ord(s) - 97 if "a" <= s <= "z" else 26 if chr(c).isalpha() else BOUND
    return out


def _gram_counter(batches):
    """Counts of character 4-grams within words (their edges included), over whole texts."""
    import numpy as np
    import pyarrow as pa

    code, total, some, held = letter_codes(), np.zeros(DEEP, "i8"), [], 0
    for b in batches:
        for text in b.column(0).to_pylist():
            if not text:
                continue
            tail = np.zeros(0, "i8")
            for k in range(0, len(text) + 1, 4_000_000):  # a piece at a time; the last three codes go on to the next
                piece = text[k : k + 4_000_000] + (" " if k + 4_000_000 > len(text) else "")
                x = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")
                c = np.where(x < 0x250, code[np.minimum(x, 0x24F)], 26)
                c = np.concatenate([tail if k else [BOUND], c])
                keep = np.ones(len(c), bool)
                keep[1:] = (c[1:] != BOUND) | (c[:-1] != BOUND)  # edges in a row are one
                c = c[keep]
                g = ((c[:-3] * BASE + c[1:-2]) * BASE + c[2:-1]) * BASE + c[3:]
                held += len(g)
                some.append(g)
                tail = c[-3:]
                if held > 1_000_000:  # counted together, as a count has the model's size
                    total += np.bincount(np.concatenate(some), minlength=DEEP)
                    some, held = [], 0
    if some:
        total += np.bincount(np.concatenate(some), minlength=DEEP)
    seen = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["g", "n"])


def character_model(docs: DataFrame, text: str = "text"):
    """log P(c4 | c1 c2 c3), backed off, as a float32 array; at most 28**4 counts reach the driver."""
    import numpy as np

    rows = docs.select(text).mapInArrow(_gram_counter, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    n4 = np.zeros(DEEP)
    n4[rows["g"].to_numpy()] = rows["n"].to_numpy()
    n4 = n4.reshape(BASE, BASE, BASE, BASE)
    p = np.full(BASE, 1 / BASE)
    for counts in (n4.sum((0, 1, 2)), n4.sum((0, 1)), n4.sum(0), n4):
        total = counts.sum(-1, keepdims=True)
        p = (counts + 5 * p) / (total + 5)
    return np.log(p).astype("f4").reshape(-1)


# --- restoring -----------------------------------------------------------------------------------

# Spaced letters (one between each two), signs in or around letters, a letter twice or more.
_SIGN, _LETTER = r"[0134578@$!|€+9]", r"[^\W\d_]"
SPACED = rf"(?<![^\W_])(?:[^\W_]|[@$!|€+])(?:[ .\-_*](?:[^\W_]|[@$!|€+])){{2,}}(?![^\W_])"
MIXED = rf"(?<![^\W_]){_SIGN}*{_LETTER}+(?:{_SIGN}+{_LETTER}+)+[0134578@$]*|(?<![^\W_]){_SIGN}+{_LETTER}+[0134578@$]*|(?<![^\W_]){_LETTER}+[0134578@$]+(?![\w@$])"
LONG = r"[^\W_]*([^\W\d_])\1[^\W_]*"
DISGUISED, ACROSS = re.compile(f"{SPACED}|{MIXED}|{LONG}"), re.compile(SPACED)
HINT = re.compile(r"[0134578@$!|€+9][^\W\d_]|[^\W\d_][0134578@$]|(?<![^\W_])[^\W_][ .\-_*][^\W_][ .\-_*][^\W_](?![^\W_])|([^\W\d_])\1")


class Restorer:
    def __init__(self, model):
        self.model, self.codes, self.known, self.words = model.tolist(), letter_codes().tolist(), {}, {}

    def code(self, c: str) -> int:
        return self.codes[ord(c)] if ord(c) < 0x250 else 26

    def lattice(self, span: str):
        """Arcs (from, to, letters, log-probability in the channel): what each group of equal characters may be."""
        s, spaced = span.lower(), bool(re.fullmatch(SPACED, span))
        if spaced:
            s = re.sub(r"[ .\-_*]", "", s)
        out, i = [], 0
        while i < len(s):
            j = i + 1
            while j < len(s) and s[j] == s[i]:
                j += 1
            n, c = j - i, s[i]
            for letter in dict.fromkeys(SIGNS.get(c, "") + (c if c.isalpha() else "")):
                out.append((i, j, letter, SINGLE if n == 2 else 0.0))
                if n >= 2:
                    out.append((i, j, letter * 2, 0.0))
                if spaced and j < len(s):  # the spaces between words are lost among those between letters
                    out.append((i, j, letter + " ", 0.0))
            i = j
        return s, out

    def decode(self, span: str) -> str:
        """The likeliest word of letters; the span itself if it has no letters to read."""
        s, arcs = self.lattice(span)
        ends: dict[int, dict] = {0: {(BOUND, BOUND, BOUND): (0.0, None)}}  # with (the way so far, letters)
        model = self.model
        by: dict[int, list] = {}
        for i, *arc in arcs:
            by.setdefault(i, []).append(arc)
        for i in range(len(s)):
            here = ends.pop(i, None)
            if not here:
                continue
            for j, w, cost in by.get(i, ()):
                slot = ends.setdefault(j, {})
                for (a, b, c), (p, done) in here.items():
                    p += cost
                    for letter in w:
                        d = self.code(letter)
                        p += model[((a * BASE + b) * BASE + c) * BASE + d]
                        a, b, c = b, c, d
                    if slot.get((a, b, c), (-1e300,))[0] < p:
                        slot[a, b, c] = (p, (done, w))
        last = ends.get(len(s))
        if not last:
            return span

        def read(way) -> str:
            out = []
            while way:
                way, w = way
                out.append(w)
            return "".join(reversed(out))

        return max((p + model[((a * BASE + b) * BASE + c) * BASE + BOUND], read(way)) for (a, b, c), (p, way) in last.items())[1]

    def one(self, m: re.Match) -> str:
        span = m.group(0)
        got = self.known.get(span)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.decode(span)
            if len(span) <= MOST_SPAN:
                self.known[span] = got
        return got

    def restore(self, text: str) -> str:
        return DISGUISED.sub(self.one, text) if HINT.search(text) else text

    def read(self, word: str) -> list[str]:
        """Words of a restored word without white space."""
        got = self.words.get(word)
        if got is None:
            got = WORD.findall(self.restore(word).lower())
            if len(word) <= MOST_SPAN:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[word] = got
        return got


# --- features ------------------------------------------------------------------------------------

WORD = re.compile(r"[^\W\d_]+")
AFFIX = (4, 5, 6)


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in AFFIX if len(word) > n), *(f"-{word[-n:]}" for n in AFFIX if len(word) > n)]


def words_of(text: str | None, restorer: Restorer) -> set[str]:
    """Distinct words of the restored text, besides those of the text as it is.

    Only spaced-out letters reach over white space; a text without them is restored a word at a time.
    """
    if not text:
        return set()
    words = set(WORD.findall(text.lower()))
    if ACROSS.search(text):
        new = restorer.restore(text)
        return words if new is text else words | set(WORD.findall(new.lower()))
    for word in set(text.split()):
        if HINT.search(word):
            words.update(restorer.read(word))
    return words


def _feature_lists(model, among=None):
    """Features of each text, or those in a set."""

    def run(batches):
        import pyarrow as pa

        restorer, few = Restorer(model.value), among.value if among else None

        def of(text):
            found = {f for w in words_of(text, restorer) for f in word_features(w)}
            return sorted(found if few is None else found & few)

        for b in batches:
            for at in range(0, b.num_rows, 100):  # all features of a whole batch would fill memory
                some = b.slice(at, 100)
                feats = pa.array([of(t) for t in some.column("text").to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([some.column("key"), some.column("y"), feats], ["key", "y", "f"])

    return run


def _scorer(model, learnt, name="score", text="_text", spare=True):
    """Batches with a score; the column of texts goes if it is there for the score alone (spare)."""

    def run(batches):
        import pyarrow as pa

        feats, base = learnt
        whole = {f: p for f, p in feats.items() if not (f.startswith("-") or f.endswith("-"))}
        heads = {n: {f[:-1]: p for f, p in feats.items() if f.endswith("-") and len(f) == n + 1} for n in AFFIX}
        tails = {n: {f[1:]: p for f, p in feats.items() if f.startswith("-") and len(f) == n + 1} for n in AFFIX}
        heads, tails = ({n: x for n, x in d.items() if x} for d in (heads, tails))
        restorer, names = Restorer(model.value), frozenset(whole)

        def score(text):
            words = words_of(text, restorer)
            found = [whole[w] for w in words & names]
            for n, d in heads.items():
                found += [d[w] for w in {w[:n] for w in words if len(w) > n} & d.keys()]
            for n, d in tails.items():
                found += [d[w] for w in {w[-n:] for w in words if len(w) > n} & d.keys()]
            if not found:
                return base
            miss = 1.0
            for p in sorted(found):
                miss *= 1 - p
            return 1 - miss

        for b in batches:
            made = pa.array([score(t) for t in b.column(text).to_pylist()], pa.float64())
            yield (b.drop_columns([text]) if spare else b).append_column(name, made)

    return run


def learn(labelled: DataFrame, model, *, min_texts: int = MIN_TEXTS, min_precision: float = MIN_PRECISION):
    """({feature: precision}, rate without any) from a bounded sample of texts (key, text, y); key is a hash of the text."""
    rows, kinds = labelled, "key string, y int, f array<string>"
    size = rows.groupBy("y").count().collect()
    n_pos, n_all = sum(r["count"] for r in size if r["y"]), sum(r["count"] for r in size)
    if not n_pos:
        return {}, 0.0
    often = rows.filter("y = 1").mapInArrow(_feature_lists(model), kinds).select(F.explode("f").alias("f")).groupBy("f").count().filter(F.col("count") >= min_texts)
    sent = rows.sparkSession.sparkContext.broadcast(frozenset(r["f"] for r in often.collect()))  # bounded by the sample
    lists = written(rows.mapInArrow(_feature_lists(model, sent), kinds), "features")
    good = lists.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("pos"), F.count("*").alias("all")).filter((F.col("pos") >= min_texts) & (F.col("pos") >= min_precision * F.col("all")))
    good = written(good, "candidates")
    rows = lists.filter("y = 1").select(F.xxhash64("key").alias("t"), F.explode("f").alias("f")).join(good, "f").groupBy("f", "pos", "all").agg(F.collect_set("t").alias("t")).collect()  # within the sample
    cover = {r["f"]: set(r["t"]) for r in rows}
    total = {r["f"]: (r["pos"], r["all"]) for r in rows}
    chosen: dict[str, float] = {}
    left = set().union(*cover.values()) if cover else set()
    explained: set = set()
    # most newly explained texts, then fewest others, whole words before affixes, long before short
    rank = lambda f, new: (-new, total[f][1] - total[f][0], f.startswith("-") or f.endswith("-"), -len(f), f)
    heap = [(*rank(f, len(c)), f) for f, c in cover.items()]
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        f = top[-1]
        new = len(cover[f] - explained)
        if new < min_texts:
            continue
        if new < -top[0]:
            heapq.heappush(heap, (*rank(f, new), f))
            continue
        pos, every = total[f]
        chosen[f] = (pos + 0.5) / (every + 1)
        explained |= cover[f]
    uncovered = n_pos - len(explained & left)
    return chosen, min(0.29, (uncovered + 0.5) / max(1, n_all - len(explained) + 1))


def scored(docs: DataFrame, labels: DataFrame, *, keep: Column, doc_id: str = "doc_id", text: str = "text", mark: str = "toxic", id_col: str = "doc_id", carry: list[str] | None = None, name: str = "score", most_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs (or their columns `carry`) with a score (0 to 1), in place of a column of that name. keep: over labels, the rows that may be learnt from."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(character_model(docs, text))
    marks = labels.filter(keep & F.col(id_col).isNotNull() & F.col(mark).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(mark).cast("int")).alias("y"))
    marks = written(marks, "marks")
    if (n := marks.count()) > most_rows:  # by a hash of the id, so about most_rows ids: small enough to broadcast
        marks = marks.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * most_rows / n))
    own = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    rows = own.join(F.broadcast(marks), "_id").groupBy(text_key(F.col("text")).alias("key")).agg(F.first("text").alias("text"), F.max("y").alias("y"))
    rows = written(rows, "labelled")
    learnt = learn(rows, model)
    kept = [c for c in carry or docs.columns if c != name]
    if text in kept:
        out = docs.select(*kept)
        return out.mapInArrow(_scorer(model, learnt, name, text, False), out.withColumn(name, F.lit(0.0)).schema)
    out = docs.select(*kept, F.col(text).alias("_text"))
    return out.mapInArrow(_scorer(model, learnt, name), out.drop("_text").withColumn(name, F.lit(0.0)).schema)


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn_from = remainder(F.col("doc_id")) != 2
    out = scored(docs, table(spark, sf_dir, "labels"), keep=learn_from, carry=["doc_id"])
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """docs without those scored at the threshold or above."""
    return scored(docs, labels, keep=remainder(F.col("doc_id")) != 2, name="_score").filter(F.col("_score") < threshold).drop("_score")
