"""The parts of the operators that need no Spark, against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seqlake.llm import line_templates as L
from seqlake.llm import minhash as M
from seqlake.llm import sanitise as S
from seqlake.llm import token_store as T
from seqlake.llm import toxicity as X


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def test_banded_alignment():
    random.seed(3)
    for _ in range(500):
        n, v = random.choice([0, 1, 3, 20, 90, 200]), random.choice([2, 5, 50])
        a = [random.randrange(v) for _ in range(n)]
        b = list(a)
        for _ in range(random.choice([0, 1, 3, 20])):
            i, o = random.randrange(len(b) + 1), random.random()
            if o < 0.33:
                b.insert(i, random.randrange(v))
            elif b and i < len(b):
                b[i : i + 1] = [] if o < 0.66 else [random.randrange(v)]
        k = random.choice([0, 1, 2, 5, 30, 100])
        assert M.edit_distance(a, b, k) == min(distance(a, b), k + 1)


def test_seeded_alignment_is_an_alignment():
    random.seed(4)
    tight = 0
    for _ in range(400):
        n, v = random.choice([0, 1, 4, 5, 30, 120]), random.choice([2, 30, 1000])
        a = [random.randrange(v) for _ in range(n)]
        b = list(a)
        for _ in range(random.choice([0, 1, 3, 10])):
            i, o = random.randrange(len(b) + 1), random.random()
            b[i : i + (o > 0.3)] = [] if o > 0.7 else [random.randrange(v)]
        if random.random() < 0.1:
            b = b[len(b) // 2 :] + b[: len(b) // 2]
        x, y, d = np.array(a, "u8"), np.array(b, "u8"), distance(a, b)
        got = M.seeded_edits(x, y, 5)
        assert d <= got <= max(len(a), len(b)) * 2
        tight += got == d
        if a and b:
            assert M.alike(x, y, 0.8, 5) == (d <= int(0.2 * max(len(a), len(b)) + 1e-9))
    assert tight > 200


def test_order_minhash_takes_the_least_in_text_order():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 40, 3000):
        h = M.labelled(rng.integers(0, max(2, n // 2), n).astype("u8"))
        assert len(set(h.tolist())) == n
        seeds = M.mix(np.arange(1, 7, dtype="u8") * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
        want = []
        for j in range(6):
            v = (h ^ (h >> np.uint64(29))) * seeds[j]
            at = np.sort(np.argsort(v, kind="stable")[:3])
            s = M.mix(np.array([j + 1], "u8"))
            for i in at:
                s = M.mix(s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + 1])
            want.append(int(s[0]))
        assert M.order_minhash(h, 6, 3).tolist() == want


def test_word_codes_ignore_case_and_white_space():
    offs, w = M.word_codes(pa.array(["A b c ", "  ", None, "a B\nC"]))
    parts = [w[offs[i] : offs[i + 1]].tolist() for i in range(4)]
    assert parts[0] == parts[3] and len(parts[0]) == 3 and parts[1] == parts[2] == []


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 40_000])
def test_frames_round_trip(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.geometric(0.01, n), 40_000)
    u, c = np.unique(np.concatenate([ids, [7, 9]]), return_counts=True)
    table = T.Table(u, c)
    frame = T.encode_block(ids, table, lanes=32, every=50)
    assert (T.decode_block(frame, table) == ids).all()
    if n > 40 * 32 * 50 // 2:
        assert (T.decode_block(frame, table, stretch=3) == ids[3 * 1600 : 4 * 1600]).all()
        broken = bytearray(frame)
        broken[-3] ^= 1
        with pytest.raises(ValueError):
            T.decode_block(bytes(broken), table)
    with pytest.raises(ValueError):
        T.encode_block([3_000_000 if n else 1], table) if n else T.decode_block(b"xxxx" + frame[4:], table)


def test_table_sums_and_crc_join():
    for counts in ([1], [1, 10**12], list(range(1, 5000)), [1] * 70_000):
        assert T.scaled(counts, 20).sum() == 1 << 20 and T.scaled(counts, 20).min() >= 1
    a, b = b"hello wor", b"ld" * 1000
    assert T.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert T.crc_join(5, 0, 0) == 5


TEXTS = ["", " ", "It's  THE end, isn't it? 12,5½", "İstanbul ΣΣ straße ﬁ été é", "a<|endoftext|>b", "x y z\x1cw\x85v", "\U0001f600 ok‍ 中文 กำ", "don'tve 'll''s !'s --'re", "a\tb\r\nc\x0bd", "ŉ Ÿ ²³ ǅ"]


def test_tokens_equal_the_library():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    ids = T.WordIds(path, "u2")
    random.seed(2)
    some = TEXTS + ["".join(random.choice("ab' .,1éßİ́<|>\n²ſ×") for _ in range(60)) for _ in range(400)]
    lens, flat = T.encode_texts(pa.array([*some, None]), ids)
    at = 0
    for s, n in zip(some, lens, strict=False):
        assert flat[at : at + n].tolist() == ids.whole.encode(s, add_special_tokens=False).ids, repr(s)
        at += n
    assert lens[-1] == 0


PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(t):
    def good(k, s):
        d = re.sub("[^0-9]", "", s)
        return k == 0 or (k == 1 and all(int(x) <= 255 for x in s.split("."))) or (k == 2 and 14 <= len(d) <= 19 and S.luhn(d)) or (k == 3 and 10 <= len(d) <= 15)

    return sorted((m.start(), k, m.end()) for k, r in enumerate(PATTERNS) for m in r.finditer(t) if good(k, m.group()))


def test_base_spans_equal_plain_patterns():
    random.seed(1)
    for _ in range(8000):
        t = "".join(random.choice(random.choice(["ab@.", "0123456789", "+ ()-.", ".1234", " -4", "@a.b"])) for _ in range(random.choice([5, 20, 60])))
        assert S.base_spans(t) == plain_spans(t), t
    t = "mail x.y@a-b.example.com or 4242 4242-4242 4242, +1 (713) 555-8702, 192.168.0.255, 300.1.1.1"
    assert [k for _, k, _ in S.base_spans(t)] == [0, 2, 3, 1]
    assert S.base_spans(None) == S.base_spans("") == []
    assert S.base_spans("9" * 100_000 + "." + "a" * 100_000 + "@") == []


def test_terms_avoid_base_spans():
    t = "alpha beta x@mail.example.com gamma"
    got = S.terms_near(t, S.base_spans(t), 8)
    assert got == {("email:x@mail.example.com", w) for w in ("alpha", "beta", "gamma")}
    keys = "key 04dbebab91ab85687d33eeaaf9ac699e1188f962, a@b.example.com/04dbebab91ab85687d33eeaaf9ac699e1188f962 aaaaaaaaaaaaaaaaaaaaaaaa1 abcdefghijklmnopqrstuvwxyz"
    assert [keys[a:b] for a, _, b in S.secrets(keys, S.base_spans(keys), 64)] == ["04dbebab91ab85687d33eeaaf9ac699e1188f962"] * 2 or S.base_spans(keys)


def test_templates():
    assert L.masked("on 2024-01-01 user7 came") == ["on", "<*>", "<*>", "came"] and L.masked("  ") == []
    how = (3, 0.7, 6, 8, 3)
    assert L.open_blocks(5, *how) == ([], []) and L.open_blocks(3, *how) == ([], [])
    cut, sets = L.open_blocks(8, *how)
    assert cut == [3, 4, 5, 6, 7, 8] and len(sets) == 10 and {len(x) for x in sets} == {2}
    for n in (6, 10, 13, 30, 400):
        cut, sets = L.open_blocks(n, *how)
        assert cut[0] == 3 and cut[-1] == n and 0 < len(sets) <= 56
        assert all(sum(cut[k + 1] - cut[k] for k in x) * 10 <= 3 * n for x in sets)
    keys = lambda t: set(L.template_keys(t.split(), 3, *L.open_blocks(len(t.split()), *how)))
    a, b, c = keys("a b c d e f g h"), keys("a b c d x f y h"), keys("a b c d x f y z")
    assert len(a & b) == 1 and not a & c and len(b & c) == 4
    assert not a & keys("a b x d e f g h") and not keys("a b c d e")


def lm(words):
    """A model of a word list, as character_model makes one of a corpus."""
    code, n4 = X.letter_codes(), np.zeros(X.DEEP)
    for w, k in Counter(words).items():
        c = [X.BOUND, *(code[ord(x)] for x in w), X.BOUND]
        for a in zip(c, c[1:], c[2:], c[3:], strict=False):
            n4[((a[0] * 28 + a[1]) * 28 + a[2]) * 28 + a[3]] += k
    n4 = n4.reshape(28, 28, 28, 28)
    p = np.full(28, 1 / 28)
    for counts in (n4.sum((0, 1, 2)), n4.sum((0, 1)), n4.sum(0), n4):
        p = (counts + 5 * p) / (counts.sum(-1, keepdims=True) + 5)
    return np.log(p).astype("f4").reshape(-1)


def test_restoring():
    r = X.Restorer(lm(["idiot", "loser", "stupid", "trash", "moron", "little"] * 50))
    for a, b in (("1d10t", "idiot"), ("l 0 s e r", "loser"), ("$tup1d", "stupid"), ("tr@sh", "trash"), ("mooooron", "moron"), ("little", "little"), ("l.i.t.t.l.e", "little")):
        assert r.restore(a) == b
    assert r.restore("plain words, 12 34") == "plain words, 12 34"
    assert r.restore("ab26" * 200)


def test_restoring_long_spans_and_doubled_letters():
    known = ["idiot", "loser", "stupid", "trash", "moron", "little", "ass"]
    r = X.Restorer(lm([f"{a} {b} {c}" for a in known for b in known for c in known]))
    words = ["idiot", "loser", "stupid", "trash", "moron"] * 4
    assert r.restore(" ".join("".join(words))).split() == words
    assert r.restore("m" + "o" * 100 + "ron") == "moron"
    for a, b in (("iddiott", "idiot"), ("a$$", "ass"), ("little", "little")):
        assert r.restore(a) == b
    assert len(r.restore("s t u p i d " * 2000 + "x").split()) >= 2000


def test_reading_by_word_equals_reading_whole_texts():
    import random

    r, rng = X.Restorer(lm(["idiot", "loser", "as", "sea", "bass"] * 20)), random.Random(5)
    texts = ["i d i o t @ b c $a b c", "a1b2ccd 1d10t", "x" * 70 + " " + "ab" * 50 + "0a"]
    texts += ["".join(rng.choice("ab1@$ .-_*sS eé\t2") for _ in range(rng.randint(1, 24))) for _ in range(3000)]
    for t in texts:
        assert X.words_of(t, r) == {*X.WORD.findall(t.lower()), *X.WORD.findall(r.restore(t).lower())}
    assert X.words_of(None, r) == X.words_of("", r) == set()


def test_viterbi_is_exact():
    import itertools

    model = lm(["idiot", "lilt", "till", "toil"] * 20)
    r = X.Restorer(model)
    for span in ("1d10t", "t11l", "7oi|", "l1l7", "t00"):
        s, arcs = r.lattice(span)
        by = {}
        for i, j, w, c in arcs:
            by.setdefault(i, []).append((j, w, c))
        best = None
        ends = sorted({0, *(j for _, j, _, _ in arcs)})
        for pick in itertools.product(*(by[i] for i in ends[:-1])):
            w, cost = "".join(p[1] for p in pick), sum(p[2] for p in pick)
            c = [X.BOUND] * 3 + [r.code(x) for x in w] + [X.BOUND]
            score = cost + sum(float(model[((c[k] * 28 + c[k + 1]) * 28 + c[k + 2]) * 28 + c[k + 3]]) for k in range(len(c) - 3))
            best = max(best or (score, w), (score, w))
        assert r.decode(span) == best[1]


def test_character_counts_do_not_depend_on_batches():
    code = X.letter_codes()
    texts = ["Ab, c--d", "", None, "x" * 10, "é ñ", "word " * 5000]
    want = Counter()
    for t in texts:
        if not t:
            continue
        c = [X.BOUND, *(int(code[ord(x)]) for x in t), X.BOUND]
        c = [x for i, x in enumerate(c) if not i or x != X.BOUND or c[i - 1] != X.BOUND]
        for q in zip(c, c[1:], c[2:], c[3:]):
            want[((q[0] * X.BASE + q[1]) * X.BASE + q[2]) * X.BASE + q[3]] += 1
    for cut in (1, 2, 6):
        batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + cut], pa.string())], ["text"]) for i in range(0, len(texts), cut)]
        (got,) = X._gram_counter(batches)
        assert dict(zip(*(got.column(k).to_pylist() for k in (0, 1)))) == want
