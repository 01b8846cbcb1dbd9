"""Token-id output as static range-ANS blocks (5).

Documents are dealt by ranges of doc_id and encoded in that order; each partition cuts its stream of
ids into blocks of about `block` tokens, which are encoded apart from each other under one frequency
table counted over all tokens. A block is a frame of interleaved lanes with a checkpoint (lane states
and word offset) every `every` steps, a checksum of each stretch of words and one of the ids, so blocks,
and stretches within a block, decode in parallel. The store is a folder of two Parquet tables, which any
file system that Spark writes can hold: `frames` and `table`, the frequencies. Its path is all that a reader
needs, in any session.

A tokenizer that lower-cases and drops white space is run on distinct chunks between white space; any other
file goes through the library's own encode_batch.

Null texts count as empty: their only id is the end id. Null ids come first. Rows with equal ids are
ordered by text, each with its own start; rows that repeat both are written each. A document of more
than a block spans several. An empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, table, written

MAGIC = b"SLR1"
END_ID = 2
BLOCK = 1 << 17
LANES = 512
EVERY = 128  # steps between checkpoints
WORDS_KEPT = 400_000  # entries of a worker's word cache

# --- tokenizer ---------------------------------------------------------------------------------

# Characters for which lower() and composition are what the tokenizer's normaliser does.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ſ]*")
_L, _N = "a-zªµº\xdf-\xf6\xf8-ſ", "0-9²³¹¼½¾"
PIECES = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")


def byte_chars() -> dict[int, str]:
    """Byte-level BPE: printable bytes stand for themselves, others for the characters from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in keep else next(rest)) for b in range(256)}


# What a tokenizer file must say for its ids to be those of its lower-cased chunks in turn.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_chunks(path: str) -> bool:
    """Does this tokenizer lower-case, and cut at white space and by SPLIT?"""
    import json

    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    steps = (own.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    cut = steps[0].get("pattern") == {"Regex": SPLIT} and steps[0].get("invert") and steps[0].get("behavior") == "Removed"
    bytes_after = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    return own.get("normalizer") == NORMALIZER and bool(cut and bytes_after) and not own.get("post_processor") and not own.get("truncation")


class WordIds(dict):
    """Ids (as bytes) of white-space-free chunks, by the tokenizers library.

    The vocabulary's pieces never cross white space, so a text's ids are those of its chunks in turn.
    Chunks of plain characters are cut here and their pieces, which repeat, encoded once by the library's
    model; all others (and such that may hold a special token) go through its whole encode().
    """

    def __init__(self, path: str, code: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.code, self.kind, self.chars = code, {"u2": "H", "u4": "I"}[code], byte_chars()
        self.plain = by_chunks(path)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        text = piece if piece.isascii() else "".join(map(self.chars.__getitem__, piece.encode()))
        got = self[piece] = array(self.kind, [t.id for t in self.model.tokenize(text)]).tobytes()
        return got

    def chunks(self, some: list[str]) -> list[bytes]:
        """The ids of each; a few hundred at a time are tested and lower-cased together."""
        out, find = [], PIECES.findall
        for at in range(0, len(some), 512):
            joined = "\n".join(some[at : at + 512])
            if PLAIN.fullmatch(joined) and "<|" not in joined:
                out += [b"".join([self[p] for p in find(s)]) for s in joined.lower().split("\n")]
            else:
                out += map(self.chunk, some[at : at + 512])
        return out

    def chunk(self, s: str) -> bytes:
        if PLAIN.fullmatch(s) and "<|" not in s:
            return b"".join([self[p] for p in PIECES.findall(s.lower())])
        return array(self.kind, self.whole.encode(s, add_special_tokens=False).ids).tobytes()


_HELD: dict[tuple[str, str], WordIds] = {}


def word_ids(path: str, code: str) -> WordIds:
    """One cache a worker, which its tasks share."""
    if (path, code) not in _HELD:
        _HELD[path, code] = WordIds(path, code)
    return _HELD[path, code]


def encode_texts(texts, ids: WordIds):
    """(lengths, ids) of an Arrow array of texts: each batch's distinct chunks are encoded once."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    dtype = np.dtype(f"<{ids.code}")
    if not ids.plain:
        every = [e.ids for e in ids.whole.encode_batch(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
        return np.array([len(e) for e in every], "i8"), np.array([x for e in every for x in e], dtype)
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    coded = pc.dictionary_encode(split.flatten())
    made = ids.chunks([s or "" for s in coded.dictionary.to_pylist()])
    size = np.fromiter(map(len, made), "i8", len(made)) // dtype.itemsize
    flat, at = np.frombuffer(b"".join(made), dtype), np.cumsum(size) - size
    index = coded.indices.to_numpy(zero_copy_only=False).astype("i8", copy=False)
    n = size[index]
    upto = np.concatenate([[0], np.cumsum(n)])
    out = flat[np.repeat(at[index] - upto[:-1], n) + np.arange(upto[-1])]
    ends = upto[np.asarray(split.offsets)]
    return np.diff(ends), out


# --- frames ------------------------------------------------------------------------------------


def scaled(counts, bits: int):
    """Counts as frequencies that sum to 2**bits, each at least 1."""
    import numpy as np

    counts = np.asarray(counts, "f8")
    f = np.maximum(1, np.floor(counts * ((1 << bits) - len(counts)) / counts.sum())).astype("i8")
    order = np.argsort(-counts, kind="stable")
    off = (1 << bits) - int(f.sum())
    if off > 0:
        f[order[0]] += off
    for i in order if off < 0 else ():
        take = min(int(f[i]) - 1, -off)
        f[i] -= take
        off += take
        if not off:
            break
    return f


class Table:
    """Symbols in order, with frequency and start of each; shared by all blocks."""

    def __init__(self, symbols, counts):
        import numpy as np

        self.symbols = np.asarray(symbols, "i8")
        self.bits = 20 if len(self.symbols) < 1 << 19 else 24
        self.freq = scaled(counts, self.bits).astype("u8")
        self.start = np.cumsum(self.freq) - self.freq

    def wide(self):
        """Frequency and start by symbol, and symbol index by slot."""
        import numpy as np

        n = int(self.symbols[-1]) + 1
        freq, start = np.zeros(n, "u8"), np.zeros(n, "u8")
        freq[self.symbols], start[self.symbols] = self.freq, self.start
        return freq, start, np.repeat(np.arange(len(self.symbols)), self.freq.astype("i8"))


LOW = 1 << 31  # states lie in [2**31, 2**63); words of 32 bits move in and out


def encode_block(ids, table: Table, wide=None, lanes: int = LANES, every: int = EVERY) -> bytes:
    """A frame: header, checkpoints, words. Ids must be in the table."""
    import numpy as np

    freq, start, _ = wide or table.wide()
    ids = np.asarray(ids, "i8")
    lanes = max(1, min(lanes, len(ids)))
    steps = -(-len(ids) // lanes)
    grid = np.concatenate([ids, np.full(steps * lanes - len(ids), int(table.symbols[0]), "i8")]).reshape(steps, lanes)
    if len(ids) and not (0 <= ids.min() and ids.max() < len(freq) and freq[ids].all()):
        raise ValueError("an id is not in the table")
    f, c = freq[grid], start[grid]
    x = np.full(lanes, LOW, "u8")
    bits, shift = np.uint64(table.bits), np.uint64(63 - table.bits)
    out, marks = [None] * steps, []
    for t in range(steps - 1, -1, -1):
        full = (x >> shift) >= f[t]
        out[t] = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
        x[full] >>= np.uint64(32)
        q = x // f[t]
        x = (q << bits) + (x - q * f[t]) + c[t]
        if t % every == 0:
            marks.append((t, x.copy()))
    sizes = np.cumsum([0, *(len(w) for w in out)])
    words = np.concatenate([np.zeros(0, "<u4"), *out]).tobytes()
    head = [MAGIC, struct.pack("<IIIIII", len(ids), lanes, every, len(marks), table.bits, zlib.crc32(ids.astype("<u4").tobytes()))]
    for t, state in reversed(marks):
        a, b = int(sizes[t]), int(sizes[min(t + every, steps)])
        head.append(struct.pack("<III", a, b - a, zlib.crc32(words[4 * a : 4 * b])) + state.astype("<u8").tobytes())
    return b"".join([*head, words])


def decode_block(frame: bytes, table: Table, wide=None, stretch: int | None = None):
    """The ids of a frame, or of one stretch between checkpoints. Raises ValueError if a checksum fails."""
    import numpy as np

    freq, start = table.freq, table.start
    slots = (wide or table.wide())[2]
    if frame[:4] != MAGIC:
        raise ValueError("not a frame")
    n, lanes, every, marks, bits, crc = struct.unpack_from("<IIIIII", frame, 4)
    if bits != table.bits:
        raise ValueError("the frame was made under another table")
    size, at = 12 + 8 * lanes, 28
    body, steps = at + size * marks, -(-n // lanes) if lanes else 0
    mask, b64, w32, low = np.uint64((1 << bits) - 1), np.uint64(bits), np.uint64(32), np.uint64(LOW)
    parts = []
    for k in range(marks) if stretch is None else [stretch]:
        a, m, check = struct.unpack_from("<III", frame, at + k * size)
        raw = frame[body + 4 * a : body + 4 * (a + m)]
        if len(raw) != 4 * m or zlib.crc32(raw) != check:
            raise ValueError(f"stretch {k} is damaged")
        words, x, p = np.frombuffer(raw, "<u4"), np.frombuffer(frame, "<u8", lanes, at + k * size + 12).copy(), 0
        last = min((k + 1) * every, steps)
        got = np.empty((last - k * every, lanes), "i8")
        for t in range(last - k * every):
            slot = x & mask
            s = slots[slot]
            got[t] = s
            x = freq[s] * (x >> b64) + slot - start[s]
            few = x < low
            take = int(np.count_nonzero(few))
            x[few] = (x[few] << w32) | words[p : p + take]
            p += take
        parts.append(table.symbols[got].reshape(-1)[: max(0, n - k * every * lanes)])
    ids = np.concatenate(parts) if parts else np.zeros(0, "i8")
    if stretch is None and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("the ids' checksum fails")
    return ids


# --- checksums over parts ------------------------------------------------------------------------


def crc_join(a: int, b: int, length: int) -> int:
    """The crc32 of two strings in turn, from that of each and the length of the second."""

    def times(m, v):
        r, i = 0, 0
        while v:
            if v & 1:
                r ^= m[i]
            v >>= 1
            i += 1
        return r

    odd = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    m = odd
    for _ in range(3):  # one zero byte
        m = [times(m, v) for v in m]
    while length:
        if length & 1:
            a = times(m, a)
        m = [times(m, v) for v in m]
        length >>= 1
    return a ^ b


# --- Spark ---------------------------------------------------------------------------------------

RAW = "pid int, seq int, n long, first long, row array<long>, doc_id array<long>, len array<long>, whole array<boolean>, ids binary"
FRAMES = "pid int, seq int, n long, first long, row array<long>, doc_id array<long>, len array<long>, whole array<boolean>, frame binary"
SEGMENT = "pid int, first long, row long, doc_id long, seq int, n long, whole boolean, crc long"


def _raw_blocks(path: str, code: str, end_id: int, block: int):
    def run(batches):
        """Blocks of ids in order, and at the end one row (seq -1) with the counts of this partition's ids."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        pid, ids = TaskContext.get().partitionId(), word_ids(path, code)
        dtype = np.dtype(f"<{code}")
        counts = np.zeros(1, "i8")
        meta, parts, held, first, seq, row_no = [], [], 0, 0, 0, 0

        def flush():
            nonlocal meta, parts, held, first, seq, counts
            flat = np.concatenate(parts).astype(dtype, copy=False)
            c = np.bincount(flat)
            if len(c) > len(counts):
                counts = np.concatenate([counts, np.zeros(len(c) - len(counts), "i8")])
            counts[: len(c)] += c
            rows, docs, lens, whole = zip(*meta, strict=True)
            out = _row(pid, seq, held, first, rows, docs, lens, whole, flat.tobytes())
            meta, parts, first, held, seq = [], [], first + held, 0, seq + 1
            return out

        def _row(pid, seq, n, first, rows, docs, lens, whole, raw):
            names = ["pid", "seq", "n", "first", "row", "doc_id", "len", "whole", "ids"]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((pid, seq, n, first, list(rows), list(docs), list(lens), list(whole), raw), kinds, strict=True)], names)

        for batch in batches:
            at, sizes = 0, pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            while at < batch.num_rows:  # some texts at a time: long ones would fill memory
                some, size = 0, 0
                while at + some < batch.num_rows and size < 8_000_000:
                    size += sizes[at + some]
                    some += 1
                lens, flat = encode_texts(batch.column(1).slice(at, some), ids)
                docs, upto = batch.column(0).slice(at, some).to_pylist(), 0
                for doc, n in zip(docs, lens.tolist(), strict=True):
                    toks = np.append(flat[upto : upto + n], dtype.type(end_id))
                    upto += n
                    if held and held + len(toks) > block:
                        yield flush()
                    for k in range(0, len(toks), block):
                        piece = toks[k : k + block]
                        meta.append((row_no, doc, len(piece), len(toks) <= block))
                        parts.append(piece)
                        held += len(piece)
                        if len(toks) > block:
                            yield flush()
                    row_no += 1
                at += some
        if held:
            yield flush()
        seen = np.nonzero(counts)[0]
        yield _row(pid, -1, 0, 0, seen.tolist(), [], counts[seen].tolist(), [], b"")

    return run


def _encoder(table, code: str, lanes: int, every: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        t = Table(*table.value)
        wide = t.wide()
        for b in batches:
            raw = b.column("ids").to_pylist()
            made = [encode_block(np.frombuffer(r, f"<{code}"), t, wide, lanes, every) for r in raw]
            yield b.drop_columns(["ids"]).append_column("frame", pa.array(made, pa.binary()))

    return run


def _decoder(table):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        t = Table(*table.value)
        wide = t.wide()
        for b in batches:
            for r in b.to_pylist():
                ids = decode_block(r["frame"], t, wide).astype("<u4")
                lens = np.array(r["len"], "i8")
                ends = np.cumsum(lens)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * int(e - n) : 4 * int(e)]) for n, e in zip(lens, ends, strict=True)]
                n = len(lens)
                yield pa.RecordBatch.from_pydict({
                    "pid": pa.array([r["pid"]] * n, pa.int32()), "first": pa.array(r["first"] + ends - lens, pa.int64()), "row": pa.array(r["row"], pa.int64()), "doc_id": pa.array(r["doc_id"], pa.int64()),
                    "seq": pa.array([r["seq"]] * n, pa.int32()), "n": pa.array(lens, pa.int64()), "whole": pa.array(r["whole"], pa.bool_()), "crc": pa.array(crc, pa.int64()),
                })

    return run


def _joined(pdf):
    """The parts of one document, in order, as one row; parts are as many as its blocks."""
    import pandas as pd

    pdf = pdf.sort_values("seq")
    crc = 0
    for c, n in zip(pdf["crc"], pdf["n"], strict=True):
        crc = crc_join(crc, int(c), 4 * int(n))
    one = pdf.iloc[0]
    return pd.DataFrame({"pid": pd.array([one["pid"]], "Int32"), "first": [pdf["first"].min()], "row": [one["row"]], "doc_id": pd.array([one["doc_id"]], "Int64"), "seq": pd.array([one["seq"]], "Int32"), "n": [int(pdf["n"].sum())], "whole": [True], "crc": [crc]})


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, *, end_id: int = END_ID, block: int = BLOCK, lanes: int = LANES, every: int = EVERY, doc_id: str = "doc_id", text: str = "text") -> str:
    """Write a store to a new folder `path` (one in the shared folder if None); returns the path."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    code = "u2" if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else "u4"
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("_h", F.xxhash64("text"))
    dealt = own.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text")
    raw = written(dealt.mapInArrow(_raw_blocks(tokenizer, code, end_id, block), RAW), "ids")
    counts = raw.filter("seq = -1").select(F.explode(F.arrays_zip("row", "len")).alias("c")).groupBy(F.col("c.row").alias("id")).agg(F.sum("c.len").alias("n"))
    counts.coalesce(1).write.parquet(f"{path}/table")  # as many rows as the vocabulary, at most
    sent = spark.sparkContext.broadcast(frequencies(spark, path))
    raw.filter("seq >= 0").mapInArrow(_encoder(sent, code, lanes, every), FRAMES).write.option("compression", "uncompressed").parquet(f"{path}/frames")
    return path


def frequencies(spark, path: str) -> tuple[list[int], list[int]]:
    """(symbols, counts) of a store, in order of symbols."""
    rows = sorted((r["id"], r["n"]) for r in spark.read.schema("id long, n long").parquet(f"{path}/table").collect())
    return ([r[0] for r in rows], [r[1] for r in rows]) if rows else ([0], [1])


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of a store, decoded from its frames."""
    frames = spark.read.schema(FRAMES).parquet(f"{path}/frames")
    sent = spark.sparkContext.broadcast(frequencies(spark, path))
    parts = written(frames.mapInArrow(_decoder(sent), SEGMENT), "parts")  # read twice below, decoded once
    cut = parts.filter("not whole").groupBy("pid", "row").applyInPandas(_joined, SEGMENT)
    docs = parts.filter("whole").unionByName(cut)
    sums = frames.groupBy("pid").agg(F.sum("n").alias("total"))  # a row for each partition that wrote
    before = sums.select("pid", (F.sum("total").over(Window.orderBy("pid")) - F.col("total")).alias("before"))
    return docs.join(before, "pid").select("doc_id", (F.col("before") + F.col("first")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def query(spark, sf_dir: str, docs: DataFrame | None = None, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return read_tokens(spark, write_tokens(table(spark, sf_dir, "documents") if docs is None else docs, tokenizer))
