"""Paths and file handles, local or on any file system that pyarrow knows."""

from __future__ import annotations

import atexit
import fnmatch
import os
import shutil
import tempfile
from collections.abc import Iterator

FASTQ_SUFFIXES = (".fastq", ".fq", ".fastq.gz", ".fq.gz")


def _remote(path: str) -> bool:
    return "://" in path and not path.startswith("file://")


def is_local(path: str) -> bool:
    return not _remote(path)


def local(path: str) -> str:
    return path.removeprefix("file://")


def scratch(spark) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; in local mode one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        own = tempfile.mkdtemp(prefix="seqlake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def open_binary(path: str, mode: str = "rb"):
    if not _remote(path):
        return open(local(path), mode)  # noqa: SIM115
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner) if mode == "rb" else store.open_output_stream(inner)


def found(paths: list[str], suffixes: tuple[str, ...], *, recurse: bool = False) -> Iterator[str]:
    """Files as given; of a folder, files with a suffix by name, then (if asked) its folders'."""
    for path in paths:
        if _remote(path):
            from pyarrow import fs

            store, inner = fs.FileSystem.from_uri(path)
            info = store.get_file_info(inner)
            if info.type == fs.FileType.Directory:
                got = sorted(x.path for x in store.get_file_info(fs.FileSelector(inner, recursive=recurse)) if x.type == fs.FileType.File)
                yield from (f"{path.split('://')[0]}://{x}" for x in got if x.endswith(suffixes))
            else:
                yield path
            continue
        path = local(path)
        if not os.path.isdir(path):
            yield path
            continue
        names = sorted(os.listdir(path))
        yield from (os.path.join(path, n) for n in names if n.endswith(suffixes) and os.path.isfile(os.path.join(path, n)))
        if recurse:
            yield from found([os.path.join(path, n) for n in names if os.path.isdir(os.path.join(path, n))], suffixes, recurse=True)


def matching(paths: Iterator[str], pattern: str | None) -> Iterator[str]:
    return (p for p in paths if not pattern or fnmatch.fnmatch(os.path.basename(p), pattern))
