"""Binary index of every n-th record: magic, then version, chunk size and count, then offset and name of each.

All numbers are unsigned 64-bit, little-endian; names end with a zero byte that counts in their length.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession

from .files import open_binary

MAGIC, VERSION = b"FANZ\0", 1


def read_index(path: str) -> tuple[int, list[tuple[int, str]]]:
    """(chunk size, [(offset, name)])."""
    with open_binary(path) as f:
        raw = f.read()
    if raw[:5] != MAGIC:
        raise ValueError("not a chunk index")
    _, size, n = struct.unpack_from("<QQQ", raw, 5)
    out, k = [], 29
    for _ in range(n):
        offset, length = struct.unpack_from("<QQ", raw, k)
        k += 16 + length
        if k > len(raw):
            raise ValueError("the chunk index is cut off")
        out.append((offset, raw[k - length : k].rstrip(b"\0").decode()))
    return size, out


def write_index(path: str, size: int, recs: list[tuple[int, str]]) -> None:
    parts = [MAGIC, struct.pack("<QQQ", VERSION, size, len(recs))]
    for offset, name in recs:
        b = name.encode() + b"\0"
        parts += [struct.pack("<QQ", offset, len(b)), b]
    with open_binary(path, "wb") as f:
        f.write(b"".join(parts))


def build_index(bam: str, path: str, *, every: int = 1) -> int:
    """Index a BAM file in one pass over its blocks; returns the number of chunks."""
    from .sam import Bgzf, bam_header

    recs, n = [], 0
    with open_binary(bam) as raw:
        bam_header(f := Bgzf(raw))
        while True:
            at = f.tell()
            size = f.read(4)
            if not size:
                break
            body = f.read(struct.unpack("<i", size)[0])
            if n % every == 0:
                recs.append((at, body[32 : 32 + body[8] - 1].decode()))
            n += 1
    write_index(path, every, recs)
    return len(recs)


def build_index_by_pieces(spark: SparkSession, bam: str, path: str, starts: list[int], *, every: int = 1) -> int:
    """The same index of a file of whose pieces the first bytes are known (sam.write_one_bam): each is counted, then indexed, in a task of its own."""
    from .sam import Bgzf, bam_header, raw_records

    def records(start: int, end: int):
        with open_binary(bam) as raw:
            if start:
                f = Bgzf(raw, start << 16)
            else:
                bam_header(f := Bgzf(raw))
            yield from raw_records(f, end=end)

    def counted(piece):
        k, start, end = piece
        return k, sum(1 for _ in records(start, end))

    def heads(piece):
        start, end, before = piece
        return [(at, raw[32 : 31 + raw[8]].decode()) for n, (at, raw) in enumerate(records(start, end), before) if n % every == 0]

    spans = [(k, a, b) for k, (a, b) in enumerate(zip(starts, [*starts[1:], 1 << 62])) if a < b]
    sc = spark.sparkContext
    counts, before, pieces = dict(sc.parallelize(spans, len(spans)).map(counted).collect()), 0, []
    for k, a, b in spans:
        pieces.append((a, b, before))
        before += counts[k]
    recs = sc.parallelize(pieces, len(pieces)).flatMap(heads).collect()
    write_index(path, every, recs)
    return len(recs)


def index_frame(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, file_offset, qname)."""
    _, recs = read_index(path)
    return spark.createDataFrame([(i, o, q) for i, (o, q) in enumerate(recs)], "chunk_id long, file_offset long, qname string")


def dump(path: str) -> str:
    size, recs = read_index(path)
    return "\n".join([f"Index contains {len(recs)} chunks of size {size}.", *(f"{o}\t{q}" for o, q in recs)])
