"""SAM text and BAM.

read_sam uses the text source and built-in functions, so large files split. BAM is a data source,
spark.read.format("bam"), one partition a file, or one a run of chunks if a chunk index is given (option `index`): up to
SPLITS runs or so, so that tasks do not grow with the chunks. Both sides exchange Arrow batches.
Both have the same columns; pos counts from 0, quality is an array of numbers (255: missing). A BAM record's
voffset is where it starts: the block's place in the file times 65,536 plus the place in the block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .chunk_index import read_index
from .files import found, is_local, local, open_binary

COLUMNS = "qname string, flag int, ref string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual array<int>, tags map<string,struct<type:string,value:string>>"
SCHEMA = f"file_path string, voffset long, {COLUMNS}"


# --- SAM -------------------------------------------------------------------------------------------


def read_sam(spark: SparkSession, *paths: str) -> DataFrame:
    """Alignment rows. Of a tag that repeats, the last counts."""
    p = F.split("value", "\t")
    rows = spark.read.text(list(paths)).filter(~F.startswith("value", F.lit("@")) & (F.col("value") != "")).select(F.input_file_name().alias("file_path"), p.alias("p"))
    tag = F.transform(F.slice("p", 12, 10_000), lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.struct(F.substring(x, 4, 1).alias("type"), F.substring(x, F.lit(6), F.length(x)).alias("value")).alias("v")))
    names = F.array_distinct(F.transform("t", lambda x: x["k"]))
    last = F.transform(names, lambda k: F.element_at(F.filter("t", lambda x: x["k"] == k), -1)["v"])
    n = lambda i, kind: F.get("p", F.lit(i)).try_cast(kind)  # noqa: E731  filters may move ahead of the one on header lines
    ref = F.get("p", F.lit(2))
    qual = F.get("p", F.lit(10))
    return rows.withColumn("t", tag).select(
        "file_path", F.lit(None).cast("long").alias("voffset"), n(0, "string").alias("qname"), n(1, "int").alias("flag"), ref.alias("ref"), (n(3, "long") - 1).alias("pos"), n(4, "int").alias("mapq"), n(5, "string").alias("cigar"),
        n(6, "string").alias("rnext"), (n(7, "long") - 1).alias("pnext"), n(8, "long").alias("tlen"), F.when(F.get("p", F.lit(9)) == "*", "").otherwise(F.get("p", F.lit(9))).alias("seq"),
        F.when(qual == "*", F.array_repeat(F.lit(255), F.length(F.get("p", F.lit(9))))).otherwise(F.transform(F.split(qual, ""), lambda c: F.ascii(c) - 33)).alias("qual"),
        F.map_from_arrays(names, last).alias("tags"),
    )


def sam_references(spark: SparkSession, *paths: str) -> DataFrame:
    """(tid, name, length) of the header; the text source keeps the order of a file's lines in value order of its offset."""
    head = spark.read.text(list(paths)).filter(F.startswith("value", F.lit("@SQ\t")))
    field = lambda k: F.regexp_extract("value", rf"\t{k}:([^\t]+)", 1)
    rows = head.select(F.monotonically_increasing_id().alias("at"), field("SN").alias("name"), field("LN").cast("long").alias("length"))
    return rows.dropDuplicates(["name"]).selectExpr("cast(row_number() over (order by at) - 1 as int) as tid", "name", "length")  # a header's rows


def sort_order(spark: SparkSession, *paths: str) -> str | None:
    row = spark.read.text(list(paths)).filter(F.startswith("value", F.lit("@HD\t"))).select(F.regexp_extract("value", r"\tSO:([^\t]+)", 1).alias("so")).first()
    return row["so"] if row else None


def require_sorted(spark: SparkSession, *paths: str) -> None:
    if sort_order(spark, *paths) != "coordinate":
        raise ValueError("the input must be sorted by coordinate")


def scalar_tags(df: DataFrame) -> DataFrame:
    """rg, rd, start_time, nm, pi, pt, dx, qs out of `tags`: either case, only of the right kind."""
    both = lambda k: F.coalesce(F.col("tags")[k.upper()], F.col("tags")[k.lower()])
    text = lambda k: F.when(both(k)["type"] == "Z", both(k)["value"])
    whole = lambda k: F.when(both(k)["type"].isin(*"cCsSiI"), both(k)["value"].try_cast("long"))
    return df.withColumns({
        "rg": text("RG"), "rd": text("RD"), "start_time": text("st"), "nm": whole("NM"), "pi": F.when(both("pi").isNotNull(), F.lit(1)), "pt": whole("pt"), "dx": F.coalesce(whole("dx"), F.lit(0)).cast("int"),
        "qs": F.when(both("qs")["type"] == "f", both("qs")["value"].try_cast("float")),
    })


# --- BGZF and BAM --------------------------------------------------------------------------------------

EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BASES, CIGAR_OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
SPLITS, BATCH = 256, 5000  # partitions of a file that has an index; records of an Arrow batch
HEAD = struct.Struct("<iiBBHHHiiii")
HEX_OF_BASE = bytes(b"0123456789abcdef"[max(0, BASES.find(chr(c).upper()))] for c in range(256))
BASE_OF_HEX = bytes(ord(BASES["0123456789abcdef".index(chr(c))]) if chr(c) in "0123456789abcdef" else c for c in range(256))
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


class Bgzf:
    """Blocks of a BGZF file, read from a virtual offset on."""

    def __init__(self, raw, voffset: int = 0):
        self.raw, self.data, self.at, self.block, self.next = raw, b"", 0, voffset >> 16, voffset >> 16
        raw.seek(self.next)
        if self._load():
            self.at = voffset & 0xFFFF

    def _load(self) -> bool:
        head = self.raw.read(12)
        if not head:
            return False
        if len(head) < 12 or head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a BGZF block")
        extra = self.raw.read(struct.unpack_from("<H", head, 10)[0])
        k = 0
        while extra[k : k + 2] != b"BC":
            k += 4 + struct.unpack_from("<H", extra, k + 2)[0]
        size = struct.unpack_from("<H", extra, k + 4)[0] + 1
        body = self.raw.read(size - 12 - len(extra))
        self.block, self.next = self.next, self.next + size
        self.data, self.at = zlib.decompress(body[:-8], -15), 0
        return True

    def tell(self) -> int:
        while self.at == len(self.data):
            if not self._load():
                return self.next << 16
        return self.block << 16 | self.at

    def read(self, n: int) -> bytes:
        parts = []
        while n:
            if self.at == len(self.data) and not self._load():
                break
            part = self.data[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)


def bam_header(f: Bgzf) -> tuple[str, list[tuple[str, int]]]:
    if f.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = f.read(struct.unpack("<i", f.read(4))[0]).rstrip(b"\0").decode()
    refs = []
    for _ in range(struct.unpack("<i", f.read(4))[0]):
        name = f.read(struct.unpack("<i", f.read(4))[0])[:-1].decode()
        refs.append((name, struct.unpack("<i", f.read(4))[0]))
    return text, refs


def aux_fields(raw: bytes) -> dict[str, tuple[str, str]]:
    out, k = {}, 0
    while k < len(raw):
        tag, kind = raw[k : k + 2].decode(), chr(raw[k + 2])
        k += 3
        if kind in "ZH":
            end = raw.index(0, k)
            value, k = raw[k:end].decode(errors="replace"), end + 1
        elif kind == "A":
            value, k = chr(raw[k]), k + 1
        elif kind == "B":
            sub, n = chr(raw[k]), struct.unpack_from("<i", raw, k + 1)[0]
            fmt = f"<{n}{NUMBERS[sub]}"
            value = ",".join([sub, *map(str, struct.unpack_from(fmt, raw, k + 5))])
            k += 5 + struct.calcsize(fmt)
        else:
            value = str(struct.unpack_from("<" + NUMBERS[kind], raw, k)[0])
            k += struct.calcsize(NUMBERS[kind])
        out[tag] = (kind, value)
    return out


def raw_records(f: Bgzf, most: int | None = None, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, body) of up to `most` records, of those that start before the file's byte `end`."""
    most = -1 if most is None else most
    while most:
        k, data = f.at, f.data
        stop = k + 4 + int.from_bytes(data[k : k + 4], "little") if k + 4 <= len(data) else len(data) + 1
        if stop <= len(data):  # it lies whole in this block
            if end is not None and f.block >= end:
                return
            f.at = stop
            yield f.block << 16 | k, data[k + 4 : stop]
        else:
            at = f.tell()
            if end is not None and at >> 16 >= end or not (size := f.read(4)):
                return
            yield at, f.read(struct.unpack("<i", size)[0])
        most -= 1


def bam_batches(records: Iterator[tuple[int, bytes]], refs: list[tuple[str, int]], path: str, columns: list[str]):
    """Arrow batches of some of the columns of SCHEMA."""
    from binascii import hexlify
    from itertools import islice

    import numpy as np
    import pyarrow as pa

    tag = pa.struct([("type", pa.string()), ("value", pa.string())])
    kinds = {"flag": pa.int32(), "mapq": pa.int32(), "voffset": pa.int64(), "pos": pa.int64(), "pnext": pa.int64(), "tlen": pa.int64()}
    name = lambda i: refs[i][0] if i >= 0 else "*"
    cigars: dict[bytes, str] = {}

    def cigar(raw: bytes) -> str:
        if raw not in cigars:
            if len(cigars) > 100_000:
                cigars.clear()
            cigars[raw] = "".join(f"{x >> 4}{CIGAR_OPS[x & 15]}" for (x,) in struct.iter_unpack("<I", raw)) or "*"
        return cigars[raw]

    while some := list(islice(records, BATCH)):
        heads = [HEAD.unpack_from(raw) for _, raw in some]
        # Where the CIGAR, the bases and the qualities start, and where these end.
        places = [(c := 32 + h[2], s := c + 4 * h[5], q := s + (h[7] + 1) // 2, q + h[7]) for h in heads]
        rows = list(zip((raw for _, raw in some), places, heads, strict=True))

        def column(c: str):
            if c == "qual":
                found = [raw[p[2] : p[3]] for raw, p, _ in rows]
                return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.frombuffer(b"".join(found), "u1").astype("i4")))
            if c == "tags":
                found = [aux_fields(raw[p[3] :]) for raw, p, _ in rows]
                flat = [x for f in found for x in f.values()]
                items = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], pa.string()) for i in (0, 1)], fields=list(tag))
                return pa.MapArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array([k for f in found for k in f], pa.string()), items)
            values = {
                "file_path": lambda: [path] * len(rows), "voffset": lambda: [at for at, _ in some], "qname": lambda: [raw[32 : p[0] - 1].decode() for raw, p, _ in rows], "flag": lambda: [h[6] for h in heads], "ref": lambda: [name(h[0]) for h in heads],
                "pos": lambda: [h[1] for h in heads], "mapq": lambda: [h[3] for h in heads], "cigar": lambda: [cigar(raw[p[0] : p[1]]) for raw, p, _ in rows], "rnext": lambda: ["=" if h[8] == h[0] and h[8] >= 0 else name(h[8]) for h in heads],
                "pnext": lambda: [h[9] for h in heads], "tlen": lambda: [h[10] for h in heads], "seq": lambda: [hexlify(raw[p[1] : p[2]]).translate(BASE_OF_HEX)[: h[7]].decode() for raw, p, h in rows],
            }[c]
            return pa.array(values(), kinds.get(c, pa.string()))

        yield pa.RecordBatch.from_arrays([column(c) for c in columns], columns)


class BamPartition(InputPartition):
    def __init__(self, path: str, voffset: int | None, most: int | None):
        super().__init__(path)
        self.path, self.voffset, self.most = path, voffset, most


class BamReader(DataSourceReader):
    def __init__(self, options, columns):
        self.path, self.index, self.chunk, self.columns = options["path"], options.get("index"), options.get("chunk"), columns

    def partitions(self):
        if not self.index:
            return [BamPartition(p, None, None) for p in found([self.path], (".bam",))]

        size, recs = read_index(self.index)
        step = max(1, len(recs) // SPLITS)
        if self.chunk is None:
            some = [BamPartition(self.path, recs[i][0], size * step) for i in range(0, len(recs), step)]
        else:
            some = [BamPartition(self.path, recs[i][0], size) for i in [int(self.chunk)] if 0 <= i < len(recs)]
        return some or [BamPartition("", None, None)]

    def read(self, partition):
        if not partition.path:
            return
        with open_binary(partition.path) as raw:
            _, refs = bam_header(f := Bgzf(raw))
            if partition.voffset is not None:
                f = Bgzf(raw, partition.voffset)
            yield from bam_batches(raw_records(f, partition.most), refs, partition.path, self.columns)


@dataclass
class Part(WriterCommitMessage):
    path: str


def bgzf_blocks(data: bytes) -> Iterator[bytes]:
    for k in range(0, len(data), 0xFF00):
        part = data[k : k + 0xFF00]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        yield b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))


def aux_bytes(tag: str, kind: str, value: str) -> bytes:
    if kind in "cCsSiI":
        return tag.encode() + b"i" + struct.pack("<i", int(value))
    if kind == "f":
        return tag.encode() + b"f" + struct.pack("<f", float(value))
    if kind in "ZH":
        return tag.encode() + kind.encode() + value.encode() + b"\0"
    return tag.encode() + b"A" + value[:1].encode() if kind == "A" else b""


def bam_bytes(batch, tids: dict[str, int]) -> list[bytes]:
    """The records of an Arrow batch."""
    import re
    from binascii import unhexlify

    import numpy as np

    col = lambda c: batch.column(batch.schema.names.index(c))
    whole = lambda c, none: col(c).fill_null(none).to_numpy(zero_copy_only=False).tolist()

    def of_each(text, make) -> list:
        """make() of every value, once for each that differs."""
        coded = text.dictionary_encode(null_encoding="encode")
        made = [make(x) for x in coded.dictionary.to_pylist()]
        return [made[i] for i in coded.indices.to_numpy(zero_copy_only=False).tolist()]

    def utf8(text) -> list[bytes]:
        text = text.fill_null("").cast("large_string")
        ends = np.frombuffer(text.buffers()[1], "i8")[text.offset : text.offset + len(text) + 1].tolist() if len(text) else [0]
        held = (text.buffers()[2] or b"") and text.buffers()[2].to_pybytes()
        return [held[a:b] for a, b in zip(ends, ends[1:])]

    def cigar(text):
        ops = [(int(n) << 4) | CIGAR_OPS.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", text or "")]
        return len(ops), struct.pack(f"<{len(ops)}I", *ops)

    def bases(text):
        return len(text or ""), unhexlify((text or "").encode("latin-1", "replace").translate(HEX_OF_BASE) + b"0" * (len(text or "") % 2))

    if col("qname").null_count or col("flag").null_count:
        raise ValueError("a record needs a name and a flag")
    quals = col("qual")
    flat = quals.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and not (flat.min() >= 0 and flat.max() <= 255):
        raise ValueError("qualities must be in range(0, 256)")
    flat, ends = flat.astype("u1").tobytes(), np.cumsum(np.append(0, quals.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).tolist()
    tags = col("tags")
    kinds = zip(of_each(tags.keys, str), of_each(tags.items.field("type"), str), utf8(tags.items.field("value")), strict=True)
    aux = [aux_bytes(tag, kind, value.decode()) for tag, kind, value in kinds]
    tag_ends = tags.offsets.to_numpy().tolist()
    bin_ = 4680  # of unplaced records; placed ones are found by chunk, not by bin
    tid = lambda x: tids.get(x, -1)
    rows = zip(utf8(col("qname")), whole("flag", 0), of_each(col("ref"), tid), whole("pos", -1), whole("mapq", 0), of_each(col("cigar"), cigar), of_each(col("rnext"), lambda x: None if x == "=" else tid(x)), whole("pnext", -1), whole("tlen", 0), of_each(col("seq"), bases), strict=True)
    out = []
    for i, (name, flag, ref, pos, mapq, (n_ops, ops), mate, pnext, tlen, (n_bases, packed)) in enumerate(rows):
        head = HEAD.pack(ref, pos, len(name) + 1, mapq, bin_, n_ops, flag, n_bases, ref if mate is None else mate, pnext, tlen)
        body = b"".join([head, name, b"\0", ops, packed, flat[ends[i] : ends[i + 1]], *aux[tag_ends[i] : tag_ends[i + 1]]])
        out.append(len(body).to_bytes(4, "little") + body)
    return out


class BamWriter(DataSourceArrowWriter):
    """A BAM file a partition, each with the header (option `header`, SAM text), or (option `pieces`) what one file is joined of."""

    def __init__(self, options, overwrite):
        import os

        self.path, self.header = options["path"], options.get("header", "@HD\tVN:1.6\tSO:unsorted\n")
        self.pieces = options.get("pieces") == "true"
        if is_local(self.path):
            os.makedirs(local(self.path), exist_ok=overwrite)

    def write(self, iterator):
        from pyspark import TaskContext

        refs = [dict(f.split(":", 1) for f in line.split("\t")[1:]) for line in self.header.splitlines() if line.startswith("@SQ\t")]
        text = self.header.encode()
        data = [b"BAM\1", struct.pack("<i", len(text)), text, struct.pack("<i", len(refs))]
        for r in refs:
            data += [struct.pack("<i", len(r["SN"]) + 1), r["SN"].encode() + b"\0", struct.pack("<i", int(r["LN"]))]
        tids = {r["SN"]: i for i, r in enumerate(refs)}
        at = TaskContext.get().partitionId()
        path = f"{self.path}/part-{at:05d}.bam"
        if self.pieces and at:
            data = []
        with open_binary(path, "wb") as f:
            held = sum(map(len, data))
            for batch in iterator:
                new = bam_bytes(batch, tids)
                data += new
                held += sum(map(len, new))
                if held > 1 << 20:
                    f.write(b"".join(bgzf_blocks(b"".join(data))))
                    data, held = [], 0
            f.write(b"".join(bgzf_blocks(b"".join(data))) + (b"" if self.pieces else EOF_BLOCK))
        return Part(path)


class BamSource(DataSource):
    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BamReader(self.options, schema.names)

    def writer(self, schema, overwrite):
        return BamWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)


def read_bam(spark: SparkSession, path: str, *, index: str | None = None, chunk: int | None = None, columns: str | None = None) -> DataFrame:
    """All columns, or only some, given with their types, which costs less."""
    register(spark)
    r = spark.read.format("bam")
    r = r.schema(columns) if columns else r
    r = r.option("index", index) if index else r
    r = r.option("chunk", chunk) if chunk is not None else r
    return r.load(path)


def write_bam(df: DataFrame, path: str, *, header: str | None = None, mode: str = "append") -> None:
    register(df.sparkSession)
    w = df.write.format("bam").mode(mode)
    (w.option("header", header) if header else w).save(path)


def write_one_bam(df: DataFrame, path: str, *, header: str) -> list[int]:
    """One BAM file of the partitions in turn, which are written side by side and then joined; returns the byte at which each starts."""
    import shutil

    register(df.sparkSession)
    df.write.format("bam").mode("append").option("header", header).option("pieces", "true").save(f"{path}-pieces")
    starts = []
    with open_binary(path, "wb") as out:
        for piece in found([f"{path}-pieces"], (".bam",)):
            starts.append(out.tell())
            with open_binary(piece) as f:
                shutil.copyfileobj(f, out, 1 << 22)
        out.write(EOF_BLOCK)
    return starts


def unaligned(reads: DataFrame) -> DataFrame:
    """Rows for write_bam from reads (name, seq, qual, tags as text): flag 4, no place."""
    from .sinks import aux_tags

    t = aux_tags(F.col("tags"))
    names = F.array_distinct(F.transform(t, lambda x: x["tag"]))
    value = F.transform(names, lambda k: F.struct(F.element_at(F.filter(t, lambda x: x["tag"] == k), -1)["type"].alias("type"), F.element_at(F.filter(t, lambda x: x["tag"] == k), -1)["value"].alias("value")))
    none = F.lit(-1).cast("long")
    return reads.select(
        F.lit("").alias("file_path"), F.lit(0).cast("long").alias("voffset"), F.col("name").alias("qname"), F.lit(4).alias("flag"), F.lit("*").alias("ref"), none.alias("pos"), F.lit(0).alias("mapq"), F.lit("*").alias("cigar"), F.lit("*").alias("rnext"), none.alias("pnext"), F.lit(0).cast("long").alias("tlen"),
        "seq", F.transform(F.split("qual", ""), lambda c: F.ascii(c) - 33).alias("qual"), F.map_from_arrays(names, value).alias("tags"),
    )


def in_region(df: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Records that overlap a half-open region; chrom "*" asks for those without a place."""
    from ..functions.alignment import op_total

    if chrom == "*":
        return df.filter(F.col("ref") == "*")
    stop = F.col("pos") + F.greatest(op_total(F.col("cigar"), "MDN=X"), F.lit(1))
    return df.filter((F.col("ref") == chrom) & (F.col("pos") < end) & (stop > start))
