"""Entries of archives and mails, which count as folders in paths."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from findling.functions import filetypes as T
from findling.sources import ole
from findling.sources.documents import mail_parts

MOST_ENTRIES, NESTED_BYTES = 20_000, 256 * 1024 * 1024
SCHEMA = "path string, size bigint, mtime double, content binary, problem string"


def kind(name: str) -> str | None:
    """zip, tar, single, library or mail by the name; null for plain files. The lists are those of the rules."""
    low = name.lower()
    if low.endswith(tuple(f".tar{x}" for x in T.SINGLES)):
        return "tar"
    if low.endswith(".tar.zst"):
        return "library"
    kinds = (("zip", T.ZIPS), ("tar", T.TARS), ("single", T.SINGLES), ("library", T.LIBRARIES), ("mail", T.MAIL_CONTAINERS))
    return next((k for k, ends in kinds if low.endswith(tuple(ends))), None)


def limited(stream, most: int) -> bytes | None:
    """At most so many bytes, whatever a header claims; null if there are more."""
    data = stream.read(most + 1)
    return None if len(data) > most else data


def safe(name: str) -> str | None:
    """A name inside a container with backslashes; null for one that would lead out of it."""
    parts = [p for p in name.replace("/", "\\").split("\\") if p not in ("", ".")]
    return "\\".join(parts) if parts and not any(p == ".." or ":" in p for p in parts) else None


def entries(name: str, data: bytes, most: int) -> Iterator[tuple[str, int, float, bytes | None, str | None]]:
    """(name, size, mtime, content, problem) of a container's files; a damaged one gives what can be read."""
    what = kind(name)
    try:
        if what == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i in z.infolist():
                    if i.is_dir():
                        continue
                    shown = i.filename
                    if i.flag_bits & 1:
                        yield shown, i.file_size, 0.0, None, "encrypted"
                        continue
                    try:
                        with z.open(i) as f:
                            body = limited(f, most)
                        yield shown, i.file_size, 0.0, body, None if body is not None else "nested_large"
                    except (zipfile.BadZipFile, EOFError, OSError, NotImplementedError):
                        yield shown, i.file_size, 0.0, None, "damaged_archive"
        elif what == "tar":
            found: dict[str, tuple] = {}
            try:
                with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
                    for i in t:
                        if i.isfile():
                            body = limited(t.extractfile(i), most)
                            # of a name that comes twice the later one counts, where the first stood
                            found[i.name] = (i.name, i.size, float(i.mtime), body, None if body is not None else "nested_large")
            except (tarfile.TarError, EOFError, OSError):
                if not found:
                    raise
            yield from found.values()
        elif what == "single":
            inner = name.rpartition(".")[0].replace("/", "\\").rpartition("\\")[2]
            opener = {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}[name.lower().rpartition(".")[2]]
            with opener(io.BytesIO(data)) as f:
                body = limited(f, most)
            yield inner, len(body or b""), 0.0, body, None if body is not None else "nested_large"
        elif what == "mail":
            attached = ole.message(ole.CompoundFile(data))[1] if data.startswith(ole.MAGIC) else mail_parts(data)[1]
            for n, body in attached:
                yield n, len(body), 0.0, body, None
        elif what == "library":
            yield "", 0, 0.0, None, "needs_windows"
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, lzma.LZMAError, ValueError, struct.error):
        yield "", 0, 0.0, None, "damaged_archive"


def walk(path: str, data: bytes, nested: bool = True, most_entries: int = MOST_ENTRIES, most_bytes: int = NESTED_BYTES, depth: int = 0) -> Iterator[tuple]:
    """A container's files with their whole paths; one level of containers inside is opened.

    Of names that differ only in case the first counts. More entries than the limit are one problem row.
    """
    seen: set[str] = set()
    for n, (name, size, mtime, body, trouble) in enumerate(entries(path, data, most_bytes)):
        if n >= most_entries:
            yield path, 0, 0.0, None, "too_many"
            return
        inner = safe(name) if name else ""
        if inner is None:
            yield f"{path}\\{name}", size, mtime, None, "odd_name"
            continue
        whole = f"{path}\\{inner}" if inner else path
        if inner and (inner.lower() in seen or seen.add(inner.lower())):
            continue
        if trouble:
            yield whole, size, mtime, None, trouble
        elif kind(inner) == "mail" and body is not None:
            yield whole, size, mtime, body, None  # a mail is a document, too
            if depth == 0 and nested:
                yield from (r for r in walk(whole, body, nested, most_entries, most_bytes, 1) if r[0] != whole)
        elif kind(inner) in ("zip", "tar", "single") and body is not None:
            if depth == 0 and nested:
                yield from walk(whole, body, nested, most_entries, most_bytes, 1)
            else:
                yield whole, size, mtime, None, "nested_deep" if depth else "nested_off"
        else:
            yield whole, size, mtime, body, None


def read_containers(files: DataFrame, path: str = "path", content: str = "content", nested: bool = True) -> DataFrame:
    """``path, size, mtime, content, problem`` of all files inside containers given with their bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data in zip(b["path"], b["content"]):
                rows, held = [], 0
                for r in walk(p, bytes(data or b""), nested):
                    rows.append(r)
                    held += len(r[3] or b"")
                    if held > 32 * 1024 * 1024:  # handed on piece by piece, so that a big archive doesn't add up
                        yield pd.DataFrame(rows, columns=["path", "size", "mtime", "content", "problem"])
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "size", "mtime", "content", "problem"])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, SCHEMA)
