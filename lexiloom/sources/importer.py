"""Batch import: files of any format to documents, sections and outcomes. A file that fails is an outcome, not an exception."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .epub import BadBook, Book
from .files import LIMITS, decoded, format_of
from .html import sections_of, title_of
from .markdown import to_html

_SECTION = pa.struct([("ordinal", pa.int32()), ("heading", pa.string()), ("text", pa.string()), ("auxiliary", pa.bool_())])
_FIELDS = "id string, name string, folder string, format string, bytes long, title string, text_status string, error string, sections array<struct<ordinal:int,heading:string,text:string,auxiliary:boolean>>"


@dataclass
class Imported:
    """documents: id, title, format, bytes, sections, text_status. sections: id, ordinal, heading, text, auxiliary.
    outcomes: name, folder, status (imported, already-in-library, failed), id, error."""

    documents: DataFrame
    sections: DataFrame
    outcomes: DataFrame


def _plain(text: str) -> str:
    parts = re.split(r"\n(?:[ \t]*\n)+", re.sub("\r\n?", "\n", text))
    return "\n".join(f"<p>{escape(p.strip(chr(10)), quote=False).replace(chr(10), '<br>')}</p>" for p in parts if p.strip())


def document_id(data: bytes, fmt: str) -> str:
    """The hash of the bytes; of text and Markdown with the format, as their bytes don't tell it."""
    return hashlib.sha256((f"{fmt}\0".encode() if fmt in ("txt", "markdown") else b"") + data).hexdigest()


def parsed(data: bytes, fmt: str, name: str) -> dict:
    """title, text_status, error, sections of a file."""
    stem = re.sub(r"\.[A-Za-z0-9]+$", "", name).strip()[:512] or "Untitled"
    out = {"title": stem, "text_status": "ready", "error": None, "sections": []}
    if fmt == "pdf":
        ok = data.startswith(b"%PDF-") and len(data) <= LIMITS["pdf"]
        return {**out, "text_status": "processing" if ok else None, "error": None if ok else "not-a-pdf"}
    if fmt not in LIMITS or len(data) > LIMITS[fmt]:
        return {**out, "text_status": None, "error": "too-large" if fmt in LIMITS else "unsupported"}
    try:
        if fmt == "epub":
            book = Book(data)
            out["title"], rows = book.title, book.sections()
        else:
            text, error = decoded(data, fmt)
            if error:
                return {**out, "text_status": None, "error": error}
            html = text if fmt == "html" else to_html(text) if fmt == "markdown" else _plain(text)
            rows = sections_of(html)
            if fmt == "html":
                out["title"] = title_of(html, stem)
    except BadBook as e:
        return {**out, "text_status": None, "error": f"bad-book: {e}"}
    if not rows:
        return {**out, "text_status": None, "error": "empty"}
    return {**out, "sections": [{k: r[k] for k in ("ordinal", "heading", "text", "auxiliary")} for r in rows]}


def _parse(batches):
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    types = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 3 + [pa.list_(_SECTION)]
    for batch in batches:
        rows = []
        for name, folder, fmt, data in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            data = data or b""
            rows.append({"id": document_id(data, fmt), "name": name, "folder": folder, "format": fmt, "bytes": len(data), **parsed(data, fmt, name or "")})
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)


def imported(files: DataFrame, known: DataFrame | None = None) -> Imported:
    """files: name, folder, content. known: id of documents that are there already."""
    head = F.substring(F.decode(F.substring("content", 1, 512), "ISO-8859-1"), 1, 512)
    rows = files.select("name", "folder", format_of(F.col("name"), head).alias("format"), "content").mapInArrow(_parse, _FIELDS)
    good = rows.where("error IS NULL")
    first = good.groupBy("id").agg(F.min(F.struct("folder", "name")).alias("first"))  # equal files: one of them
    if known is not None:
        first = first.join(known.select("id"), "id", "left_anti")
    fresh = good.join(first, "id").where((F.col("first.folder") == F.col("folder")) & (F.col("first.name") == F.col("name"))).drop("first")
    documents = fresh.select("id", "title", "format", "bytes", F.size("sections").alias("sections"), "text_status")
    sections = fresh.select("id", F.explode("sections").alias("s")).select("id", "s.*")
    new = fresh.select(F.col("folder").alias("f"), F.col("name").alias("n"), F.lit(True).alias("new"))
    outcomes = rows.select("name", "folder", "id", "error").join(new, (F.col("folder") == F.col("f")) & (F.col("name") == F.col("n")), "left")
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("new"), "imported").otherwise("already-in-library")
    return Imported(documents, sections, outcomes.select("name", "folder", status.alias("status"), "id", "error"))


def summary(outcomes: DataFrame) -> DataFrame:
    s = F.col("status")
    return outcomes.agg(F.count("*").alias("selected"), F.count_if(s == "imported").alias("imported"), F.count_if(s == "already-in-library").alias("existing"), F.count_if(s == "failed").alias("failed"))


def finalized(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Staged page documents, published once all their pages are there: id, pages, text_status.

    documents: id, pages (how many there are to be); pages: id, page_index, text. Documents that lack pages stay as they are.
    """
    own = pages.groupBy("id").agg(F.countDistinct("page_index").alias("found"), F.max("page_index").alias("last"), F.bool_or(F.col("text").rlike(r"\S")).alias("readable"))
    rows = documents.select("id", "pages").join(own, "id", "left")
    complete = (F.col("found") == F.col("pages")) & (F.col("last") == F.col("pages") - 1)
    status = F.when(complete & F.col("readable"), "ready").when(complete, "recognition-required").otherwise("processing")
    return rows.select("id", "pages", status.alias("text_status"))
