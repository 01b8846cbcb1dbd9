"""FASTQ reader: spark.read.format("fastq").load(path), after register(spark).

One partition a file, plain or gzip (a gzip stream cannot be split). Each record is a row with its status:
R_RECORD_OK, F_QUAL_MISSING or F_QUAL_TRUNCATED; each file ends with a row without a name, F_FILE_OK or
F_STREAM_ERROR. Sequences and qualities may span lines. A record without qualities, or with fewer or more
than bases, does not stop a file; as the last one it is a stream error besides.

Options: path or paths (a JSON list), recursive (true or false).
"""

from __future__ import annotations

import gzip
import io
import json
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .files import FASTQ_SUFFIXES, found, open_binary

SCHEMA = StructType([StructField("file_path", StringType()), StructField("ordinal", LongType()), *(StructField(c, StringType()) for c in ("name", "comment", "seq", "qual", "status"))])
OK, MISSING, TRUNCATED = "R_RECORD_OK", "F_QUAL_MISSING", "F_QUAL_TRUNCATED"


def records(lines: Iterator[str]) -> Iterator[tuple[str, str, str, str, str]]:
    """(name, comment, seq, qual, status) of each record."""
    head = None
    lines = iter(lines)
    while True:
        while head is None or head[:1] not in "@>" or not head:
            head = next(lines, None)
            if head is None:
                return
        cut = next((i for i, c in enumerate(head) if c.isspace()), len(head))
        name, comment = head[1:cut], head[cut + 1 :]
        seq, line = [], next(lines, None)
        while line is not None and line[:1] not in ("@", ">", "+"):
            seq.append("".join(line.split()))
            line = next(lines, None)
        bases = "".join(seq)
        if line is None or line[0] != "+":
            yield name, comment, bases, "", OK if not bases else MISSING
            head = line
            if line is None:
                return
            continue
        qual, size = [], 0
        head = None
        while size < len(bases) or (not bases and not qual):
            line = next(lines, None)
            if line is None:
                break
            qual.append(line)
            size += len(line)
        text = "".join(qual)
        yield name, comment, bases, text, OK if size == len(bases) else TRUNCATED if size else MISSING


def file_rows(path: str) -> Iterator[tuple]:
    """All rows of a file; a damaged stream ends it."""
    n, last, end = 0, OK, "F_FILE_OK"
    try:
        with open_binary(path) as raw:
            start = raw.read(2)
        with open_binary(path) as raw:
            stream = gzip.GzipFile(fileobj=raw) if start == b"\x1f\x8b" else raw
            lines = (s.rstrip("\r\n") for s in io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline="\n"))
            for name, comment, seq, qual, status in records(lines):
                yield path, n, name, comment, seq, qual, status
                n, last = n + 1, status
    except (OSError, EOFError, zlib.error):
        end = "F_STREAM_ERROR"
    if last != OK:
        end = "F_STREAM_ERROR"
    yield path, n, None, None, None, None, end


class FilePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        given = json.loads(options["paths"]) if options.get("paths") else [options["path"]]
        self.files = list(found(given, FASTQ_SUFFIXES, recurse=str(options.get("recursive", "false")).lower() == "true"))

    def partitions(self):
        return [FilePartition(p) for p in self.files] or [FilePartition("")]

    def read(self, partition):
        if partition.path:
            yield from file_rows(partition.path)


class FastqSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FastqReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)


def read_fastq(spark: SparkSession, *paths: str, recursive: bool = False):
    register(spark)
    return spark.read.format("fastq").option("paths", json.dumps(list(paths))).option("recursive", str(recursive)).load()
