"""Texts of files: plain, Office and PDF, told by extension; then chunks, symbols and references of each text."""

from __future__ import annotations

import hashlib
import io
import os
import shutil
import subprocess
import tempfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from terrane.sources import code
from terrane.sources.policy import LANGUAGES

EXTRACT_BYTES = 2 << 20
HEAD_BYTES = 8 << 10

# Media types of Office files.
OFFICE = {
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}


class ExtractionError(ValueError):
    """A file whose text can't be had."""


def sniff(data: bytes) -> str:
    """Media type by the first bytes, as browsers do it."""
    head = data[:512]
    plain = head.lstrip(b"\t\n\x0c\r ")
    for marks, kind in (
        ((b"%PDF-",), "application/pdf"),
        ((b"\x89PNG\r\n\x1a\n",), "image/png"),
        ((b"\xff\xd8\xff",), "image/jpeg"),
        ((b"GIF87a", b"GIF89a"), "image/gif"),
        ((b"PK\x03\x04",), "application/zip"),
        ((b"\x1f\x8b\x08",), "application/x-gzip"),
    ):
        if head.startswith(marks):
            return kind
    low = plain[:64].lower()
    if any(low.startswith(t) for t in (b"<!doctype html", b"<html", b"<head", b"<body", b"<script", b"<!--")):
        return "text/html; charset=utf-8"
    if plain.startswith(b"<?xml"):
        return "text/xml; charset=utf-8"
    if head.startswith((b"\xfe\xff", b"\xff\xfe")):
        return "text/plain; charset=utf-16le" if head[0] == 0xFF else "text/plain; charset=utf-16be"
    if any(b < 9 or 13 < b < 27 or 27 < b < 32 or b == 11 for b in head):
        return "application/octet-stream"
    return "text/plain; charset=utf-8"


def plain_text(data: bytes, limit: int = EXTRACT_BYTES) -> str:
    """The first ``limit`` bytes as text; empty if they hold a NUL or aren't whole UTF-8, as for a character cut by the limit."""
    head = data[:limit]
    if b"\0" in head:
        return ""
    try:
        return head.decode()
    except UnicodeDecodeError:
        return ""


def _office_entry(extension: str, name: str) -> bool:
    if extension == ".docx":
        return name == "word/document.xml" or name.startswith(("word/header", "word/footer"))
    if extension == ".pptx":
        return name.startswith("ppt/slides/slide") and name.endswith(".xml")
    return name == "xl/sharedStrings.xml" or name.startswith("xl/worksheets/sheet")


def _xml_text(data: bytes, limit: int) -> str:
    """Texts of the elements t and v, each followed by a space, and a line feed at the end of p, row and si."""
    out, size = [], 0

    def put(text: str) -> bool:
        nonlocal size
        data = text.encode()
        if size + len(data) > limit:
            out.append(data[: max(0, limit - size)].decode("utf-8", "ignore"))
            return False
        out.append(text + " ")
        size += len(data) + 1
        return True

    for event, element in ET.iterparse(io.BytesIO(data), ("end",)):
        del event
        name = element.tag.rsplit("}", 1)[-1]
        if name in ("t", "v") and element.text and not put(element.text):
            break
        if name in ("p", "row", "si"):
            out.append("\n")
            size += 1
    return "".join(out)


def office_text(data: bytes, extension: str, limit: int = EXTRACT_BYTES) -> str:
    """Text of the parts of an Office file, by the names of the parts. A part of over eight times the limit is refused."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ExtractionError(str(e)) from None
    out: list[str] = []
    size = 0
    for entry in sorted((e for e in archive.infolist() if _office_entry(extension, e.filename)), key=lambda e: e.filename):
        if size >= limit:
            break
        if entry.file_size > limit * 8:
            raise ExtractionError(f"{entry.filename} is too large")
        try:
            text = _xml_text(archive.read(entry), limit - size)
        except (ET.ParseError, zipfile.BadZipFile) as e:
            raise ExtractionError(f"{entry.filename}: {e}") from None
        if out and text:
            out.append("\n")
        out.append(text)
        size += len(text.encode())
    return "".join(out).strip()


def pdf_text(data: bytes, limit: int = EXTRACT_BYTES, timeout: float = 30) -> str:
    """Text of a PDF by the program pdftotext, which must be installed."""
    program = shutil.which("pdftotext")
    if program is None:
        raise ExtractionError("pdftotext isn't installed")
    with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
        f.write(data)
        f.flush()
        try:
            run = subprocess.run([program, "-layout", "-nopgbrk", f.name, "-"], capture_output=True, timeout=timeout, check=True)
        except (subprocess.SubprocessError, OSError) as e:
            raise ExtractionError(str(e)) from None
    return run.stdout[:limit].decode("utf-8", "ignore")


def extract(path: str, data: bytes, limit: int = EXTRACT_BYTES) -> tuple[str, str]:
    """(text, media type) of a file."""
    extension = os.path.splitext(path)[1].lower()
    if extension == ".pdf":
        return pdf_text(data, limit), "application/pdf"
    if extension in OFFICE:
        return office_text(data, extension, limit), OFFICE[extension]
    return plain_text(data, limit), sniff(data)


_SCHEMA = (
    "path string, text string, mime string, language string, content_hash string, error string, "
    "chunks array<struct<ordinal:int,symbol:string,start_line:int,end_line:int,content:string,content_hash:string>>, "
    "symbols array<struct<symbol:string,start_line:int,end_line:int>>, "
    "refs array<struct<caller:string,callee:string,line:int>>"
)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def document(path: str, data: bytes, limit: int = EXTRACT_BYTES) -> dict:
    """What a file gives: its text, and the chunks, symbols and references of that."""
    extension = os.path.splitext(path)[1].lower()
    error = None
    try:
        text, mime = extract(path, data, limit)
    except ExtractionError as e:
        text, mime, error = "", "", str(e)
    chunks, definitions, references = [], [], []
    if text.strip():
        chunks = code.code_chunks(text, extension)
        definitions, references = code.symbols(text, extension)
    return {
        "path": path,
        "text": text,
        "mime": mime,
        "language": LANGUAGES.get(extension, ""),
        "content_hash": _hash(text),
        "error": error,
        "chunks": [(i, c.symbol, c.start, c.end, c.content, _hash(c.content)) for i, c in enumerate(chunks)],
        "symbols": [(d.symbol, d.start, d.end) for d in definitions],
        "refs": [(r.caller, r.callee, r.line) for r in references],
    }


_COLUMNS = ["path", "text", "mime", "language", "content_hash", "error", "chunks", "symbols", "refs"]


def extract_files(files: DataFrame, limit: int = EXTRACT_BYTES) -> DataFrame:
    """``files`` (path, content as bytes) with their texts, chunks, symbols and references.

    A file that can't be read has an ``error`` and no text; the others are not touched by that.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [document(p, bytes(c or b""), limit) for p, c in zip(frame["path"], frame["content"], strict=True)]
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return files.select("path", "content").mapInPandas(run, _SCHEMA)


def _content(path: str, limit: int) -> bytes | None:
    """At most one byte over the limit of a file, but Office and PDF files, which are only whole in full; null if it is gone."""
    whole = os.path.splitext(path)[1].lower() in (".pdf", *OFFICE)
    try:
        with open(path, "rb") as f:
            return f.read() if whole else f.read(limit + 1)
    except OSError:
        return None


def read_contents(entries: DataFrame, limit: int = EXTRACT_BYTES) -> DataFrame:
    """``path, content`` of the files among ``entries``, at most one byte over the limit; a file that is gone is left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, c) for p in frame["path"] if (c := _content(p, limit)) is not None]
            yield pd.DataFrame(rows, columns=["path", "content"])

    return entries.filter(F.col("kind") == "file").select("path").mapInPandas(run, "path string, content binary")


def read_texts(entries: DataFrame, limit: int = EXTRACT_BYTES) -> DataFrame:
    """``extract_files(read_contents(entries))`` where the files are, so that no content leaves the process that reads it."""
    spark = entries.sparkSession
    kinds = to_arrow_schema(spark.createDataFrame([], _SCHEMA).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in kinds], schema=kinds)

        rows: list[dict] = []
        size = 0
        for paths in batches:
            for path in paths.column(0).to_pylist():
                if (content := _content(path, limit)) is None:
                    continue
                rows.append(document(path, content, limit))
                size += len(content)
                if len(rows) == 1000 or size > 8 << 20:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    return entries.filter(F.col("kind") == "file").select("path").mapInArrow(run, _SCHEMA)
